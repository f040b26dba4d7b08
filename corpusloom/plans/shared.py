"""The folder that all executors share, and folders in it that last as long as the program."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_HELD: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only in local mode, where it is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc._jsc.sc().getCheckpointDir().get()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "corpusloom-checkpoints")
    return named.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jvm.org.apache.hadoop.conf.Configuration() if spark.sparkContext._jsc is None else spark._jsc.hadoopConfiguration()
    where.getFileSystem(conf).delete(where, True)


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted at the end of the program."""
    path = f"{shared_folder(spark)}/corpusloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _HELD.append((spark, path))
    return path


@atexit.register
def _delete_held() -> None:
    while _HELD:
        try:
            delete(*_HELD.pop())
        except Exception:  # noqa: BLE001 - the JVM may be gone before us
            pass
