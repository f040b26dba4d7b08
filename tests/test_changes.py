from pyspark.sql import functions as F

from corpusloom.operators import changes as C
from corpusloom.operators import evaluation as E


def pairs(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_latest_rows_and_upsert(spark):
    rows = spark.createDataFrame([("a", 1, "x", "k"), ("a", 2, "y", None), ("b", 1, None, "k")], "chunk_id string, at int, text string, _b string")
    last = C.latest_rows(rows, ["chunk_id"], ["at"])
    assert pairs(last, "chunk_id", "at") == [("a", 2), ("b", 1)] and last.columns == rows.columns
    new = spark.createDataFrame([("b", 5, "z", None), ("c", 1, "w", None)], rows.schema)
    merged = C.upsert(last, new)
    assert pairs(merged, "chunk_id", "at") == [("a", 2), ("b", 5), ("c", 1)]
    assert pairs(C.upsert(merged, new), "chunk_id", "at") == pairs(merged, "chunk_id", "at")
    assert C.upsert(last.where("false"), new).count() == 2 and C.upsert(last, new.where("false")).count() == 2


def test_delete_paths(spark):
    rows = spark.createDataFrame([("a/x.py", 1), ("a/y.py", 2)], "relative_path string, n int")
    gone = C.normal_paths(spark, ["a\\x.py", "../y.py", "/a/y.py", "a/x.py"])
    assert pairs(gone, "relative_path") == [("a/x.py",)]
    assert pairs(C.delete_paths(rows, gone), "n") == [(2,)]
    assert C.normal_paths(spark, []).count() == 0


def test_snapshot_diff(spark):
    s = "relative_path string, mtime_ns bigint"
    old = spark.createDataFrame([("same", 1), ("changed", 1), ("gone", 1), ("null", None)], s)
    new = spark.createDataFrame([("same", 1), ("changed", 2), ("new", 1), ("null", None)], s)
    assert pairs(C.snapshot_diff(old, new), "relative_path", "op") == [("changed", "changed"), ("gone", "deleted"), ("new", "new")]
    assert C.snapshot_diff(new, new).count() == 0


def test_reconcile(spark):
    chunks = spark.createDataFrame(
        [("code", "a", 10.0), ("docs", "a", 1.0), ("code", "b", 10.0), ("code", "b", 9.0), ("docs", "c", 5.0), ("code", "t", 1759000000.1234567)],
        "scope string, relative_path string, source_mtime double",
    )
    current = spark.createDataFrame([("a", 10 * 10**9), ("b", 10 * 10**9), ("d", 1), ("t", 1759000000123456710)], "relative_path string, mtime_ns bigint")
    got = C.reconcile(C.indexed_paths(chunks), current)
    assert pairs(got, "relative_path", "op") == [("b", "changed"), ("c", "deleted"), ("d", "new")]
    h = "relative_path string, file_hash string"
    by_hash = C.reconcile(spark.createDataFrame([("a", "1"), ("b", "1")], h), spark.createDataFrame([("a", "1"), ("b", "2")], h), by_hash=True)
    assert pairs(by_hash, "relative_path", "op") == [("b", "changed")]


def test_hit_at_k(spark):
    results = spark.createDataFrame([("r", "q1", "x", 1), ("r", "q1", "y", 4), ("r", "q2", "z", 2), ("r", "q3", "z", 1)], "run_label string, name string, relative_path string, position int")
    queries = spark.createDataFrame([("q1", ["y"]), ("q2", ["z"]), ("q3", None)], "name string, expected_any array<string>")
    assert pairs(E.hit_at_k(results, queries, 3, ("run_label",)).where(F.col("hit_top_k").isNotNull()), "name", "hit_top_k") == [("q1", False), ("q2", True)]
    assert pairs(E.hit_at_k(results.drop("run_label"), queries, 4).where("hit_top_k"), "name") == [("q1",), ("q2",)]


def test_run_queries(spark):
    found = spark.createDataFrame([("a.py",), ("b.py",)], "relative_path string")
    queries = spark.createDataFrame([("one", "x", ["b.py"]), ("two", "y", None)], "name string, query string, expected_any array<string>")
    got = E.run_queries(spark, lambda q, k: found.limit(k), queries, "label")
    assert [(r["name"], r["hit_top_k"], r["top_paths"]) for r in got.orderBy("name").collect()] == [("one", True, ["a.py", "b.py"]), ("two", None, ["a.py", "b.py"])]
