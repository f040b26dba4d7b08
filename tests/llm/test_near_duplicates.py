import itertools
import random

from corpusloom.llm import near_duplicates as N

ROWS = "chunk_id string, text string, class_id string"


def jaccard(a, b, width):
    s = [set(zip(*(N.tokens(t)[i:] for i in range(width)))) for t in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def corpus(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for n in range(60):
        base = [r.choice(words) for _ in range(r.choice([8, 33, 60, 150, 400]))]
        texts.append(" ".join(base))
        for _ in range(2):
            edited = list(base)
            for _ in range(max(1, len(base) // r.choice([12, 30, 60]))):
                edited[r.randrange(len(edited))] = r.choice(words)
            texts.append(" ".join(edited))
    boiler = " ".join(words[:12])
    return texts + [boiler + " " + " ".join(r.choice(words) for _ in range(40)) for _ in range(60)]


def test_listed_values_meet_for_similar_sets():
    """Whatever the order of rarity: the values that one sketch lists and the other one leaves out are too few."""
    r = random.Random(4)
    for threshold in (0.7, 0.8):
        met = 0
        for _ in range(2000):
            n = r.choice([r.randrange(1, 60), r.randrange(60, 400)])
            a = {r.getrandbits(40) for _ in range(n)}
            drop = set(r.sample(sorted(a), int(len(a) * r.random() * 0.3)))
            b = (a - drop) | {r.getrandbits(40) for _ in range(int(len(a) * r.random() * 0.1))}
            if not b or len(a & b) / len(a | b) < threshold:
                continue
            met += 1
            order = {v: r.random() for v in a | b}
            x, y = (sorted(sorted(s)[:40], key=order.get)[: N.listed(len(s), threshold, 40)] for s in (a, b))
            assert len(set(x) & set(y)) >= min(N.MEETINGS, N.least_overlap(min(len(a), len(b)), threshold, 40))
        assert met > 300


def test_one_rule_for_all_sizes():
    assert [N.listed(n, 0.7, 40) for n in (1, 2, 10, 28)] == [1, 2, 6, 11] and N.listed(29, 0.7, 40) == 29 - 15 + 3 and N.listed(5000, 0.7, 40) == 28


def test_pack():
    import numpy as np

    h = np.array([1 << 20, 2**64 - 1, 5 << 40], dtype=np.uint64)
    assert (N.unpack(N.pack(h)) == (h >> np.uint64(16)) << np.uint64(16)).all()


def test_pairs_against_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(f"c{i:03d}", t, "clash") for i, t in enumerate(texts)], ROWS)
    for threshold, width, least in ((0.7, 3, 30), (0.8, 5, 0)):
        want = {(f"c{i:03d}", f"c{j:03d}") for i, j in itertools.combinations(range(len(texts)), 2) if min(len(N.tokens(texts[i])), len(N.tokens(texts[j]))) >= max(least, width) and jaccard(texts[i], texts[j], width) >= threshold}
        got = {(r["chunk_id_a"], r["chunk_id_b"]) for r in N.near_duplicate_pairs(df, threshold, width, least).collect()}
        assert got == want and len(want) > 20


def test_groups(spark):
    a = " ".join(f"x{i}" for i in range(100))
    b, c = a.replace("x50", "y"), a.replace("x50", "y").replace("x10", "z")
    rows = [("1", a, None), ("2", a, None), ("2", a, None), ("3", b, None), ("4", c, None), ("5", "short text", None), ("6", "", None), ("7", None, None), (None, a, None), ("8", "short text", None)]
    df = spark.createDataFrame(rows, ROWS)
    got = {r["chunk_id"]: r for r in N.near_duplicate_groups(df).collect()}
    assert set(got) == {"1", "2", "3", "4", "5", "6", "8"}
    assert len({got[i]["group_id"] for i in "1234"}) == 1 and got["5"]["group_id"] == got["8"]["group_id"] != got["6"]["group_id"]
    assert (got["1"]["copies"], got["1"]["links"], got["3"]["links"], got["5"]["links"], got["5"]["copies"]) == (2, 2, 2, 0, 2)
    assert N.near_duplicate_groups(df.where("false")).count() == 0 and N.near_duplicate_pairs(df.where("false")).count() == 0


def test_large_groups_of_copies_give_a_star(spark):
    text = " ".join(f"x{i}" for i in range(40))
    df = spark.createDataFrame([(f"c{i:03d}", text, None) for i in range(70)] + [("d", text.replace("x39", "q"), None)], ROWS)
    got = {(r["chunk_id_a"], r["chunk_id_b"]) for r in N.near_duplicate_pairs(df, expand=64).collect()}
    assert got == {("c000", f"c{i:03d}") for i in range(1, 70)} | {("c000", "d")}
    assert N.near_duplicate_pairs(df, expand=70).count() == 70 * 69 // 2 + 70


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["class_id"]: r["group_id"] for r in N.components(links).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100


def test_very_long_text(spark):
    text = " ".join(str(i) for i in range(60_000))
    df = spark.createDataFrame([("a", text, None), ("b", text + " more", None)], ROWS)
    assert N.near_duplicate_pairs(df).count() == 1
