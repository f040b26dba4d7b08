"""Set-based changes of an index: upsert, deletion by path, and the two kinds of difference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths


def latest_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write wins: per key the whole row with the greatest `order`; extra columns keep their names."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_b")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col("_b")[c].alias(c) for c in rest]).select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of `new`, and those of `old` whose key is not in it."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_paths(rows: DataFrame, touched: DataFrame, keys: tuple[str, ...] = ("relative_path",)) -> DataFrame:
    """Rows whose path is not touched, for all paths in one anti join."""
    return rows.join(touched.select(*keys).distinct(), list(keys), "left_anti").select(*rows.columns)


def normal_paths(spark, given: list[str]) -> DataFrame:
    """Distinct normalised relative paths; absolute ones and ones leaving the tree are refused."""
    rows = spark.createDataFrame([(p,) for p in sorted(set(given))], "relative_path string") if given else spark.createDataFrame([], "relative_path string")
    return rows.select(paths.posix(F.col("relative_path")).alias("relative_path")).where(paths.is_confined(F.col("relative_path"))).distinct()


def snapshot_diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("relative_path",)) -> DataFrame:
    """keys, op: `new`, `changed` (another mtime_ns) or `deleted`; unchanged paths are left out."""
    o = old.select(*keys, F.col("mtime_ns").alias("_old"), F.lit(True).alias("_had"))
    n = new.select(*keys, F.col("mtime_ns").alias("_new"), F.lit(True).alias("_has"))
    op = F.when(F.col("_had").isNull(), "new").when(F.col("_has").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return o.join(n, list(keys), "full").select(*keys, op.alias("op")).where(F.col("op").isNotNull())


def indexed_paths(chunks: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, relative_path, source_mtime: one row an indexed path, from its code chunks if it has any.

    The oldest chunk decides, so leftovers of an earlier version make their path due for indexing.
    """
    code = F.when(F.col("scope") == "code", F.col("source_mtime"))
    return chunks.groupBy(*keys, "relative_path").agg(F.coalesce(F.min(code), F.min("source_mtime")).alias("source_mtime"))


def reconcile(indexed: DataFrame, current: DataFrame, keys: tuple[str, ...] = (), tolerance: float = 1e-6, by_hash: bool = False) -> DataFrame:
    """keys, relative_path, op of the paths to index again: new, changed (time beyond the tolerance, or another
    content hash with `by_hash`), deleted.

    `current` needs mtime_ns, or file_hash; `indexed` source_mtime, or file_hash.
    """
    on = [*keys, "relative_path"]
    mine = F.col("file_hash") if by_hash else F.col("source_mtime")
    theirs = F.col("file_hash") if by_hash else F.col("mtime_ns") / F.lit(1e9)
    i = indexed.select(*on, mine.alias("_old"), F.lit(True).alias("_had"))
    c = current.select(*on, theirs.alias("_new"), F.lit(True).alias("_has"))
    differs = ~F.col("_old").eqNullSafe(F.col("_new")) if by_hash else F.coalesce(F.abs(F.col("_old") - F.col("_new")) > tolerance, ~F.col("_old").eqNullSafe(F.col("_new")))
    op = F.when(F.col("_had").isNull(), "new").when(F.col("_has").isNull(), "deleted").when(differs, "changed")
    return i.join(c, on, "full").select(*on, op.alias("op")).where(F.col("op").isNotNull())
