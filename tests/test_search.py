import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.config import Settings
from corpusloom.functions import text
from corpusloom.operators import search as S
from corpusloom.plans import queries

CHUNKS = "chunk_id string, scope string, relative_path string, chunk_type string, domain_tags array<string>, text string, vector array<float>"


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        ("a", "code", "apps/a.py", "python_function", ["general"], "alpha beta beta", [1.0, 0.0]),
        ("b", "code", "apps/b.py", "python_function_part", ["flow01"], "beta gamma", [0.8, 0.6]),
        ("c", "docs", "docs/c.md", "markdown_section", ["docs"], "alpha", [0.0, 1.0]),
        ("d", "docs", "docs/d.md", "markdown_section", ["docs", "general"], "", [0.6, 0.8]),
        ("e", "docs", "docs/e.md", "markdown_section", ["docs"], None, None),
        ("f", "docs", "docs/f.md", "markdown_section", ["docs"], "delta delta alpha", [0.0, 0.0]),
    ]
    return spark.createDataFrame(data, CHUNKS)


def ids(df):
    return [r["chunk_id"] for r in df.collect()]


def test_dense(rows):
    assert ids(S.dense_search(rows, [1.0, 0.0], 3)) == ["a", "b", "d"]
    assert ids(S.dense_search(rows, [1.0, 0.0], 10, ("docs",))) == ["d", "c"]
    assert ids(S.dense_search(rows, [1.0, 0.0], 10, keep=S.chunk_filter(chunk_types=["python_function"]))) == ["a"]
    assert ids(S.dense_search(rows, [1.0, 0.0], 10, keep=S.chunk_filter(chunk_types=["python_function"], with_parts=True))) == ["a", "b"]
    assert ids(S.dense_search(rows, [1.0, 0.0], 10, keep=S.chunk_filter(path_prefix="docs\\"))) == ["d", "c"]
    assert ids(S.dense_search(rows, [1.0, 0.0], 10, keep=S.chunk_filter(domain_tags=["flow01", "general"]))) == ["a", "b", "d"]


def test_filter_acts_after_the_shortlist(rows):
    keep = S.chunk_filter(chunk_types=["python_function_part"])
    assert ids(S.dense_search(rows, [1.0, 0.0], 1, ("code",), keep, overfetch=1, floor=1)) == []
    assert ids(S.dense_search(rows, [1.0, 0.0], 1, ("code",), keep, overfetch=1, floor=1, prefilter=True)) == ["b"]


def okapi(corpus, query):
    docs = {k: [t.lower() for t in re.findall(text.TOKEN, v or "")] for k, v in corpus.items()}
    df = Counter(t for d in docs.values() for t in set(d))
    n, avgdl = len(docs), sum(map(len, docs.values())) / max(1, len(docs))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw) if raw else 0
    out = {}
    for k, d in docs.items():
        out[k] = sum((raw[t] if raw[t] >= 0 else 0.25 * mean) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for t in re.findall(text.TOKEN, query.lower()) if t in raw and d.count(t))
    return out


def test_bm25_agrees_with_the_formula(spark, data):
    corpus = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    df = spark.createDataFrame(list(corpus.items()), "chunk_id long, text string")
    for query in ("the merged window the", "zzz", "", "и после"):
        got = {r["chunk_id"]: r["lexical_raw"] for r in S.bm25(df, query).collect()}
        want = okapi(corpus, query)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_bm25_by_scope_uses_its_own_statistics(rows):
    got = {r["chunk_id"]: r["lexical_raw"] for r in S.bm25(rows, "alpha", by=("scope",)).collect()}
    docs = okapi({"c": "alpha", "d": "", "e": None, "f": "delta delta alpha"}, "alpha")
    code = okapi({"a": "alpha beta beta", "b": "beta gamma"}, "alpha")
    assert all(abs(got[k] - v) < 1e-9 for k, v in (docs | code).items())


def test_bm25_of_nothing(spark, rows):
    assert S.bm25(rows.where("false"), "alpha").count() == 0
    blank = spark.createDataFrame([("x", "")], "chunk_id string, text string")
    assert [r["lexical_raw"] for r in S.bm25(blank, "alpha").collect()] == [0.0]


def test_tokenize_stats_of_documents_without_tokens(spark, tmp_path):
    texts = ["b a B", "", " \n", "日本語 — ё", None, "яблоко Z"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["tokenize_stats"](spark, str(tmp_path)).collect()}
    assert got == {0: (3, 2, "a"), 1: (0, 0, ""), 2: (0, 0, ""), 3: (0, 0, ""), 4: (None, None, ""), 5: (2, 2, "z")}


def test_fusion(spark):
    dense = spark.createDataFrame([("a", 0.8), ("b", 0.5)], "chunk_id string, dense_score double")
    raw = spark.createDataFrame([("a", 0.0), ("b", 4.0), ("c", 2.0), ("d", 0.0)], "chunk_id string, lexical_raw double")
    got = {r["chunk_id"]: round(r["score"], 6) for r in S.fuse(dense, S.normalise(raw)).collect()}
    assert got == {"b": 0.65, "a": 0.56, "c": 0.15, "d": 0.0}


def test_normalise_keeps_order_of_negative_scores_out(spark):
    raw = spark.createDataFrame([("a", -1.0), ("b", -2.0)], "chunk_id string, lexical_raw double")
    assert {r["lexical_score"] for r in S.normalise(raw).collect()} == {0.0}


def test_hybrid(rows):
    got = S.hybrid_search(rows, "alpha", [0.0, 1.0], 6).collect()
    assert got[0]["chunk_id"] == "c" and len(got) == 6
    only = S.hybrid_search(rows, "!!", [1.0, 0.0], 2).collect()
    assert [r["chunk_id"] for r in only] == ["a", "b"] and only[0]["lexical_score"] is None
    assert Settings().dense_weight == 0.7


def test_batch_knn_is_exact(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = S.batch_knn(e, q, 5, "vec_id", "embedding", block=3, most_blocks=2)
    one = q.orderBy("query_id").first()
    want = [r["vec_id"] for r in S.dense_topk(e, one["query_vector"], 5, "vec_id", "embedding").collect()]
    assert [r["id"] for r in got.where(F.col("query_id") == one["query_id"]).orderBy("rank").collect()] == want


def test_plans_prune_and_push_down(spark, data):
    chunks = spark.read.parquet(f"{data}/chunks.parquet")
    plan = S.dense_search(chunks.select("chunk_id", "scope", "vector", "chunk_type"), [1.0] * 64, 10)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(scope,code)" in plan and "symbol_path" not in plan.split("== Physical Plan ==")[1]
