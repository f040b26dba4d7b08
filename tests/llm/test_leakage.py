import random

import pytest

from corpusloom.llm import leakage as L

DOCS = "doc_id bigint, text string, item_id string"
ITEMS = "item_id bigint, passage string, doc_id string"


def exact_pairs(docs, items):
    grams = {}
    for i, p in items:
        w = L.words(p)
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out = set()
    for d, t in docs:
        w = L.words(t)
        for k in range(len(w) - 12):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + 13]), ())}
    return out


@pytest.fixture(scope="module")
def case():
    r = random.Random(2)
    vocabulary = [f"wört{i}" for i in range(400)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([8, 13, 30, 60])))) for i in range(30)]
    docs = []
    for d in range(200):
        body = r.choices(vocabulary, k=60)
        _, passage = items[d % 30]
        w = passage.split()
        n = r.choice([0, 12, 13, 20, len(w)])
        docs.append((d, " ".join(body[:30]) + ". " + ", ".join(x.upper() for x in w[:n]) + "_ " + " ".join(body[30:])))
    return docs, items


def test_exact_leaks(spark, case):
    docs, items = case
    d = spark.createDataFrame([(*x, "clash") for x in docs], DOCS)
    i = spark.createDataFrame([(*x, "clash") for x in items], ITEMS)
    want = exact_pairs(docs, items)
    for most in (2_000_000, 0):  # one block, and a block for each passage
        got = {(r["doc_id"], r["item_id"]) for r in L.find_leaks(d, i, most_windows=most).where("exact").collect()}
        assert got == want and len(want) > 50


def test_substitutions(spark):
    words = [f"w{i}" for i in range(60)]
    replaced = [("x" if k % 9 == 5 else w) for k, w in enumerate(words)]
    d = spark.createDataFrame([(1, "before " + " ".join(replaced) + " after", None), (2, " ".join(reversed(words)), None)], DOCS)
    i = spark.createDataFrame([(7, " ".join(words), None)], ITEMS)
    got = L.find_leaks(d, i).collect()
    assert [(r["doc_id"], r["exact"], r["longest_run"], r["matched_words"], r["replaced_words"], r["item_words"]) for r in got] == [(1, False, 8, 53, 6, 60)]


def test_masks():
    assert all(len(m) == L.SPAN and m.count("1") >= 8 for m in L.MASKS) and len(set(L.MASKS)) == len(L.MASKS)
    assert L.words("Ab_c d-1 É") == ["ab", "c", "d", "1", "é"]


def test_edges(spark):
    long = " ".join(f"z{i}" for i in range(40))
    d = spark.createDataFrame([(1, long, None), (1, long, None), (2, None, None), (None, long, None), (3, "", None), (4, long + " x" * 100_000, None)], DOCS)
    i = spark.createDataFrame([(1, long, None), (1, long, None), (2, None, None), (3, "", None), (None, long, None)], ITEMS)
    assert sorted((r["doc_id"], r["item_id"]) for r in L.find_leaks(d, i).collect()) == [(1, 1), (4, 1)]
    assert L.find_leaks(d.where("false"), i).count() == 0 and L.find_leaks(d, i.where("false")).count() == 0
    with pytest.raises(ValueError):
        L.find_leaks(d, i, least_run=12)
