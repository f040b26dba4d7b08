"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.shared import delete, shared_folder

CHUNK_LIMIT = 800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TABLES: dict[str, tuple] = {}  # path -> (session, weak reference to the file listing that every plan over the table holds)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows once as a table in the shared folder and read them from there.

    Later stages depend on those files alone, so a lost executor costs no recomputation of what came before,
    and each reader takes only its columns. A table is deleted once no frame over it is left (`sweep`, which each
    further call runs), and at the end of the program at the latest.
    """
    spark = df.sparkSession
    sweep()
    path = f"{shared_folder(spark)}/corpusloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    listing = table._jdf.queryExecution().analyzed().relation().location()
    _TABLES[path] = (spark, spark._jvm.java.lang.ref.WeakReference(listing))
    return table


def sweep() -> int:
    """Delete the tables that no plan in the driver's memory can read any more; how many are left."""
    for path, (spark, listing) in list(_TABLES.items()):
        if listing.refersTo(None):
            delete(spark, path)
            _TABLES.pop(path, None)
    return len(_TABLES)


@atexit.register
def _delete_all() -> None:
    for path in list(_TABLES):
        try:
            delete(_TABLES[path][0], path)
            delete(_TABLES[path][0], path.rsplit("/", 1)[0])
        except Exception:  # noqa: BLE001 - the JVM may be gone before us
            pass
        _TABLES.pop(path, None)


def spread(scan: DataFrame) -> DataFrame:
    """Give a CPU-heavy map over a scan at least as many partitions as there are cores; a larger scan keeps its own splits.

    For frames without a shuffle only: to ask an aggregate for its partitions would run it. Behind a shuffle the
    adaptive plan keeps the cores busy by itself.
    """
    n = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= n else scan.repartition(n)


def clear_shared(spark: SparkSession) -> None:
    """Delete all tables that `cut` wrote. For the end of an application: earlier frames cannot be read afterwards."""
    delete(spark, f"{shared_folder(spark)}/corpusloom")
    _TABLES.clear()


def posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def known_time(mtime_ns: str = "mtime_ns") -> Column:
    """A null time is least. Python batches with nulls would turn all times to floats and lose their last digits."""
    return F.coalesce(mtime_ns, F.lit(-(2**63))).alias("mtime_ns")


def latest(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The row with the greatest `order` per key, by a partial aggregate instead of a window sort."""
    best = F.max(F.struct(*order, *[v for v in values if v not in order])).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{v}").alias(v) for v in values])
