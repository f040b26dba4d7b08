"""Registered queries of the training-data operators. Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import leakage, mixing, near_duplicates, neighbours, parsing, provenance, quality, secrets, splitting
from .common import CHUNK_LIMIT, table
from .sql import ORACLE  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# The chunk vectors have no structure below a cosine of 0.7: their tenth neighbour is hardly nearer than chance.
WIDE = {"probes": 0.5, "centroids": 32}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parse_files(table(spark, d, "source_files")).where(~F.col("parses")).select("repo_key", "relative_path")


@query
def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parse_rates(table(spark, d, "source_files"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "chunks"), min_cosine=0.9).select("chunk_id_a", "chunk_id_b")


@query
def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_vectors(table(spark, d, "chunks"), k=10, **WIDE).withColumn("cosine", F.round("cosine", 6))


@query
def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.recall(table(spark, d, "chunks"), k=10, **WIDE)


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_oversized(table(spark, d, "chunks"), limit=CHUNK_LIMIT, overlap=80)
    return pieces.where((F.col("n_pieces") > 1) & (F.col("piece_no") == 0)).select("chunk_id").distinct()


@query
def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks"), limit=CHUNK_LIMIT, overlap=80)


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(table(spark, d, "chunks"), threshold=0.7, width=3, least_tokens=30)


@query
def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, d, "chunks"), threshold=0.8, width=5)


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find_secrets(table(spark, d, "chunks")).select("chunk_id", "line_no").distinct()


@query
def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redact(table(spark, d, "chunks"))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.where("exact").select("doc_id", "item_id")


@query
def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query
def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "source_targets"))[0]


@query
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "source_targets"))[1]


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    stats = quality.text_statistics(table(spark, d, "documents"), table(spark, d, "common_words"), table(spark, d, "doc_labels"))
    return stats.where(~F.col("is_prose")).select("doc_id").distinct()


@query
def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(table(spark, d, "documents"), table(spark, d, "common_words"), table(spark, d, "doc_labels"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.classify_files(table(spark, d, "source_files")).where(F.col("kind").isNotNull()).select("repo_key", "relative_path")


@query
def p4_files(spark: SparkSession, d: str) -> DataFrame:
    return provenance.classify_files(table(spark, d, "source_files"))
