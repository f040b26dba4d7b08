import itertools

import numpy as np

from corpusloom.llm import neighbours as N

ROWS = "chunk_id string, scope string, vector array<float>, indexed_at timestamp, key string"


def make(spark, vectors, scope="code"):
    return spark.createDataFrame([(f"c{i:05d}", scope, [float(x) for x in v], None, "clash") for i, v in enumerate(vectors)], ROWS)


def brute(vectors, least):
    m = np.asarray(vectors, dtype="<f4").astype(float)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    return {(f"c{i:05d}", f"c{j:05d}") for i, j in itertools.combinations(range(len(m)), 2) if s[i, j] >= least}


def test_probe_order_is_by_summed_distance():
    r = np.random.default_rng(1)
    d1, d2 = r.random(7), r.random(5)
    got = N.probe_cells(d1, d2, 20)
    want = sorted(itertools.product(range(7), range(5)), key=lambda c: d1[c[0]] + d2[c[1]])[:20]
    assert got == want and len(N.probe_cells(d1, d2, 100)) == 35


def test_pairs_against_brute_force(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(60, 16))
    near = np.concatenate([base, base + 0.05 * r.normal(size=base.shape), base[:5], r.normal(size=(300, 16))])
    got = {(x["chunk_id_a"], x["chunk_id_b"]) for x in N.similar_pairs(make(spark, near), 0.9).collect()}
    want = brute(near, 0.9)
    assert got <= want and len(got) >= 0.98 * len(want)


def test_salted_blocks_change_nothing(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(150, 8))
    df = make(spark, v)
    plain = sorted(map(tuple, N.similar_vectors(df, 5, centroids=2, probes=4).select("chunk_id", "neighbour_id", "rank").collect()))
    salted = sorted(map(tuple, N.similar_vectors(df, 5, centroids=2, probes=4, block=20).select("chunk_id", "neighbour_id", "rank").collect()))
    assert plain == salted and len(plain) == 150 * 5
    exact = N.exact_neighbours(df, 5, every=1).select("chunk_id", "neighbour_id", "rank").collect()
    assert sorted(map(tuple, exact)) == plain


def test_hot_copies(spark):
    df = make(spark, [[1.0, 0.0]] * 40 + [[0.9, 0.1], [0.0, 1.0]])
    got = N.similar_vectors(df, 3).collect()
    by = {}
    for x in got:
        by.setdefault(x["chunk_id"], []).append((x["rank"], x["neighbour_id"]))
    assert len(by) == 42 and sorted(by["c00000"])[0] == (1, "c00001") and sorted(n for _, n in by["c00039"]) == ["c00000", "c00001", "c00002"]
    assert sorted(n for _, n in by["c00040"]) == ["c00000", "c00001", "c00002"]


def test_edges(spark):
    rows = [
        ("a", "code", [1.0, 0.0], None, None),
        ("a", "code", [1.0, 0.0], None, None),
        ("b", "docs", [1.0, 0.0], None, None),
        ("c", "code", [2.0, 0.0], None, None),
        ("d", "code", [0.0, 0.0], None, None),
        ("e", "code", None, None, None),
        ("f", "code", [], None, None),
        ("g", "code", [float("nan"), 1.0], None, None),
        ("h", "code", [1.0, None], None, None),
        ("i", None, [1.0, 0.0], None, None),
        ("j", None, [1.0, 0.1], None, None),
        ("k", "code", [1.0, 0.0, 0.0], None, None),
        (None, "code", [1.0, 0.0], None, None),
    ]
    df = spark.createDataFrame(rows, ROWS)
    assert sorted((x["chunk_id_a"], x["chunk_id_b"]) for x in N.similar_pairs(df, 0.9).collect()) == [("a", "c"), ("i", "j")]
    assert N.similar_vectors(df.where("false")).count() == 0 and N.similar_pairs(df.where("chunk_id = 'a'")).count() == 0


def test_recall(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(400, 16))
    got = N.recall(make(spark, v), 5, every=7, probes=0.6, centroids=8).first()
    assert got["n_true"] == 5 * got["n_queries"] and got["recall"] >= 0.85
    full = N.recall(make(spark, v), 5, every=7, probes=1_000, centroids=8).first()
    assert full["recall"] == 1.0
