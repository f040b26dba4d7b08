"""Continuous tracking of a repository as a stream of path changes.

The file stream of Spark sees new names only, neither edits nor deletions, so the source compares snapshots of the
tree. Its offset is the number of the last snapshot taken; snapshots are kept in the state folder, so a batch that
failed is read again alike after a restart and no change is lost.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from corpusloom.sources.crawl import walk


def snapshot(root: str) -> dict[str, int]:
    return {path: mtime for path, mtime, _ in walk(root)}


def difference(old: dict[str, int], new: dict[str, int]) -> list[tuple[str, str]]:
    """(path, op) in path order."""
    ops = {p: "new" if p not in old else "changed" for p, m in new.items() if old.get(p) != m} | {p: "deleted" for p in old if p not in new}
    return sorted(ops.items())


class _Changes(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.state = options["path"], Path(options["state"])
        self.state.mkdir(parents=True, exist_ok=True)

    def _load(self, n: int) -> dict[str, int]:
        f = self.state / f"{n}.json"
        return json.loads(f.read_text()) if f.exists() else {}

    def _save(self, n: int, seen: dict[str, int]) -> None:
        draft = self.state / f"{n}.tmp"
        draft.write_text(json.dumps(seen))
        os.replace(draft, self.state / f"{n}.json")

    def initialOffset(self) -> dict:
        if not (self.state / "0.json").exists():
            self._save(0, snapshot(self.root))
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        old, new = self._load(start["n"]), snapshot(self.root)
        found = difference(old, new)
        if not found:
            return iter([]), start
        self._save(start["n"] + 1, new)
        return iter(found), {"n": start["n"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(difference(self._load(start["n"]), self._load(end["n"])))

    def commit(self, end: dict) -> None:
        for f in self.state.glob("*.json"):
            if f.stem.isdigit() and 0 < int(f.stem) < end["n"]:
                f.unlink(missing_ok=True)


class RepositoryChanges(DataSource):
    """readStream.format("repository_changes").option("state", folder).load(root): relative_path, op"""

    @classmethod
    def name(cls) -> str:
        return "repository_changes"

    def schema(self) -> str:
        return "relative_path string, op string"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Changes(self.options)


def change_stream(spark: SparkSession, root: str, state: str) -> DataFrame:
    spark.dataSource.register(RepositoryChanges)
    return spark.readStream.format("repository_changes").option("state", state).load(str(root))


class Watcher:
    """Feeds the changed paths of each trigger to Engine.reindex; Spark retries a failed batch from its checkpoint."""

    def __init__(self, engine, folder: str):
        self.engine, self.folder, self.query = engine, Path(folder), None

    def start(self) -> None:
        if self.is_running():
            return
        changed = change_stream(self.engine.spark, self.engine.settings.repo_root, str(self.folder / "state"))

        def apply(batch: DataFrame, _: int) -> None:
            if not batch.isEmpty():
                self.engine.reindex(batch)

        self.query = (
            changed.writeStream.foreachBatch(apply)
            .option("checkpointLocation", str(self.folder / "checkpoint"))
            .trigger(processingTime=f"{self.engine.settings.watch_debounce_sec} seconds")
            .start()
        )
        self.engine.watcher = self

    def stop(self, timeout_seconds: int = 10) -> None:
        if self.query is not None:
            self.query.stop()
            self.query.awaitTermination(timeout_seconds)

    def is_running(self) -> bool:
        return bool(self.query is not None and self.query.isActive)
