"""The files of a repository as rows.

Spark's own binary source hides names that begin with `_` or `.` and cuts times to milliseconds, so the tree is
walked with os.scandir: the driver lists the top folders and each partition of the data source walks its share,
reading names, sizes and nanosecond times; bytes are read where the rows are made.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from corpusloom.config import Settings
from corpusloom.functions import paths
from corpusloom.schemas import FILE, QUERY


def walk(root: str, below: str = "", deep: bool = True) -> Iterator[tuple[str, int, int]]:
    """(relative path with `/`, mtime_ns, size) of regular files; links are not followed."""
    try:
        entries = sorted(os.scandir(os.path.join(root, below)), key=lambda e: e.name)
    except (FileNotFoundError, NotADirectoryError, PermissionError):
        return
    for e in entries:
        path = f"{below}/{e.name}" if below else e.name
        if e.is_dir(follow_symlinks=False):
            if deep:
                yield from walk(root, path)
        elif e.is_file(follow_symlinks=False):
            try:
                s = e.stat(follow_symlinks=False)
            except FileNotFoundError:
                continue
            yield path, s.st_mtime_ns, s.st_size


FOLDERS_A_TASK = 64


class _Share(InputPartition):
    def __init__(self, folders: list[tuple[str, bool]]):
        self.folders = folders


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.content = options["path"], options.get("content", "true").lower() != "false"

    def partitions(self) -> list[_Share]:
        """The root's own files and the folders two levels down, dealt out: 32 shares at first, of up to FOLDERS_A_TASK folders, then more."""
        folders = [("", False)]
        for top in sorted(os.scandir(self.root), key=lambda e: e.name):
            if top.is_dir(follow_symlinks=False):
                folders.append((top.name, False))
                folders += [(f"{top.name}/{e.name}", True) for e in sorted(os.scandir(top.path), key=lambda e: e.name) if e.is_dir(follow_symlinks=False)]
        n = min(len(folders), max(32, len(folders) // FOLDERS_A_TASK))
        return [_Share(folders[i::n]) for i in range(n)]

    def read(self, partition: _Share) -> Iterator[tuple]:
        for path, mtime_ns, size in (found for below, deep in partition.folders for found in walk(self.root, below, deep)):
            body = None
            if self.content:
                try:
                    with open(os.path.join(self.root, path), "rb") as f:
                        body = f.read()
                except OSError:
                    continue
            yield path, body, mtime_ns, size


class RepositoryTree(DataSource):
    """spark.read.format("repository_tree").option("content", "false").load(root)"""

    @classmethod
    def name(cls) -> str:
        return "repository_tree"

    def schema(self) -> StructType:
        return FILE

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TreeReader(self.options)


def crawl(spark: SparkSession, root: str, settings: Settings, content: bool = True) -> DataFrame:
    """Indexable files under a root that all executors see: relative_path, content, mtime_ns, size."""
    spark.dataSource.register(RepositoryTree)
    rows = spark.read.format("repository_tree").option("content", str(content).lower()).load(str(root))
    p = F.col("relative_path")
    return rows.where(paths.is_text_like(p) & paths.should_index(p, settings.include_globs, settings.excludes))


def read_paths(touched: DataFrame, root: str, settings: Settings) -> DataFrame:
    """As `crawl`, for the relative paths of a frame: only these files are looked at. Those that are gone give no row."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for path in batch["relative_path"]:
                full = os.path.join(root, path)
                try:
                    s = os.stat(full, follow_symlinks=False)
                    if not stat.S_ISREG(s.st_mode):
                        continue
                    with open(full, "rb") as f:
                        out.append((path, f.read(), s.st_mtime_ns, s.st_size))
                except OSError:
                    continue
            yield pd.DataFrame(out, columns=FILE.fieldNames())

    p = F.col("relative_path")
    chosen = touched.select(paths.posix(p).alias("relative_path")).where(paths.is_confined(p) & paths.is_text_like(p) & paths.should_index(p, settings.include_globs, settings.excludes)).distinct()
    return chosen.mapInPandas(run, FILE)


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {name, query, expected_any}."""
    return spark.read.schema(QUERY).json(path, multiLine=True)
