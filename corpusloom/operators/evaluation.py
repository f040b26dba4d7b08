"""Hit rates, latencies and comparison of runs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hit_at_k(results: DataFrame, queries: DataFrame, k: int = 3, run: tuple[str, ...] = ()) -> DataFrame:
    """run..., name, hit_top_k: whether one of the first k paths is expected. Null or empty expectations give null.

    results: run..., name, relative_path, position (from 1). Without `run`, queries that
    have no results are misses; with it, the queries of a run are those it has results for.
    """
    top = results.where(F.col("position") <= k).groupBy(*run, "name").agg(F.collect_set("relative_path").alias("_paths"))
    wanted = F.col("expected_any")
    known = wanted.isNotNull() & (F.size(wanted) > 0)
    base = results.select(*run, "name").distinct().join(queries, "name") if run else queries
    hit = F.coalesce(F.arrays_overlap("_paths", wanted), F.lit(False))
    return base.join(top, [*run, "name"], "left").select(*run, "name", F.when(known, hit).alias("hit_top_k"))


def compare_runs(results: DataFrame) -> DataFrame:
    """run_label, calls, queries, mean of elapsed_ms, hit rate: one row a run for side-by-side reading."""
    calls = results.groupBy("run_label", "query_name", "served_at").agg(F.max("elapsed_ms").alias("elapsed_ms"), F.max("hit_top_k").alias("hit"))
    return calls.groupBy("run_label").agg(
        F.count("*").alias("calls"),
        F.countDistinct("query_name").alias("queries"),
        F.round(F.avg("elapsed_ms"), 6).alias("mean_ms"),
        F.round(F.avg(F.when(F.col("hit"), 1.0).when(~F.col("hit"), 0.0)), 6).alias("hit_rate"),
    )


def run_queries(spark: SparkSession, search: Callable[[str, int], DataFrame], queries: DataFrame, label: str, top_k: int = 3) -> DataFrame:
    """label, name, elapsed_ms, hit_top_k, top_paths of a query set against a live engine. The set is a short list."""
    rows = []
    for q in queries.select("name", "query", "expected_any").collect():
        began = time.perf_counter()
        paths = [r["relative_path"] for r in search(q["query"], top_k).select("relative_path").collect()]
        took = (time.perf_counter() - began) * 1000
        expected = q["expected_any"]
        rows.append((label, q["name"], took, bool(set(paths) & set(expected)) if expected else None, paths))
    return spark.createDataFrame(rows, "label string, name string, elapsed_ms double, hit_top_k boolean, top_paths array<string>")
