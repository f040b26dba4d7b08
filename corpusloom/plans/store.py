"""The chunk table: Parquet by bucket, version and scope, and a pointer to the versions in force.

A path's chunks lie in one bucket. A change writes the buckets of its paths anew under a new version and then moves the
pointer by one rename; the other buckets keep their files. Readers keep the versions they opened: what a change replaced
goes `keep_versions` changes later. A lock file made exclusively keeps two writers apart. Files are reached through the Hadoop
file systems, so the index may lie on any of them.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.config import Settings
from corpusloom.operators import changes, search
from corpusloom.schemas import CHUNK

SCOPES = ("code", "docs")
_PLACE = [T.StructField("bucket", T.IntegerType()), T.StructField("version", T.StringType())]
FILES = T.StructType([T.StructField("relative_path", T.StringType()), T.StructField("mtime_ns", T.LongType()), T.StructField("file_hash", T.StringType())])
POSTINGS = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("dl", T.IntegerType()), T.StructField("scope", T.StringType())])
LENGTHS = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("dl", T.IntegerType()), T.StructField("scope", T.StringType())])
VOCABULARY = T.StructType([T.StructField("term", T.StringType()), T.StructField("df", T.LongType()), T.StructField("scope", T.StringType())])


class Files:
    """The few file operations the store needs, on the file system of its folder."""

    def __init__(self, spark: SparkSession, home: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(home).getFileSystem(self.conf)
        self.is_local = self.fs.getUri().getScheme() == "file"

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def make(self, path: str) -> bool:
        return self.fs.mkdirs(self.path(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def age_seconds(self, path: str) -> float:
        return time.time() - self.fs.getFileStatus(self.path(path)).getModificationTime() / 1000

    def read(self, path: str) -> str | None:
        if not self.exists(path):
            return None
        stream = self.fs.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self.fs.create(self.path(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, draft: str, path: str) -> None:
        """One rename over what is there."""
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        self.jvm.java.lang.reflect.Array.set(options, 0, rename.OVERWRITE)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.path(draft), self.path(path), options)

    def create_alone(self, path: str) -> bool:
        """Make a file that must not be there; whether it was ours to make."""
        if self.is_local:  # Hadoop's local file system looks first and creates then
            try:
                os.close(os.open(self.path(path).toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                return True
            except FileExistsError:
                return False
        try:
            self.fs.create(self.path(path), False).close()
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise


class ChunkStore:
    def __init__(self, spark: SparkSession, root: str | Path, settings: Settings, keep_versions: int = 2, bucket_rows: int = 50_000):
        self.spark, self.settings, self.keep, self.bucket_rows = spark, settings, keep_versions, bucket_rows
        self.home = f"{str(root).rstrip('/')}/{settings.index_name()}"
        self.files = Files(spark, self.home)

    @property
    def pointer(self) -> str:
        return f"{self.home}/CURRENT"

    def meta(self) -> dict:
        text = self.files.read(self.pointer)
        return json.loads(text) if text else {}

    def exists(self, scope: str | None = None) -> bool:
        m = self.meta()
        return bool(m) and (scope is None or m["counts"].get(scope, 0) > 0)

    def existing_scopes(self) -> list[str]:
        return [s for s in SCOPES if self.exists(s)]

    # Reading

    def _table(self, name: str, schema: T.StructType, parts: dict[str, str]) -> DataFrame:
        """The rows of the buckets' versions in force; the other folders are pruned before the scan."""
        where = f"{self.home}/{name}"
        if not parts or not self.files.exists(where):
            return self.spark.createDataFrame([], schema)
        by_version: dict[str, list[int]] = {}
        for bucket, version in parts.items():
            by_version.setdefault(version, []).append(int(bucket))
        keep = F.lit(False)
        for version, buckets in by_version.items():
            keep = keep | ((F.col("version") == version) & F.col("bucket").isin(buckets))
        rows = self.spark.read.schema(T.StructType([*schema.fields, *_PLACE])).parquet(where)
        return rows.where(keep).select(*schema.fieldNames())

    def _chunks(self, parts: dict[str, str]) -> DataFrame:
        return self._table("chunks", CHUNK, parts)

    def chunks(self, scope: str | None = None, vectors: bool = True) -> DataFrame:
        """The current rows; an index that does not exist is empty."""
        rows = self._chunks(self.meta().get("parts", {}))
        rows = rows if scope is None else rows.where(F.col("scope") == scope)
        return rows if vectors else rows.drop("vector")

    def chunk(self, scope: str, chunk_id: str) -> DataFrame:
        """No row or one."""
        return self.chunks(scope, vectors=False).where(F.col("chunk_id") == chunk_id).limit(1)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows of all wanted (scope, chunk_id), each once; what is not there gives none."""
        return self.chunks(vectors=False).join(wanted.select("scope", "chunk_id").distinct(), ["scope", "chunk_id"], "left_semi")

    def manifest(self) -> DataFrame:
        """relative_path, mtime_ns, file_hash of every file seen, also of those without chunks."""
        return self._table("files", FILES, self.meta().get("file_parts", {}))

    def _lexical(self) -> dict[str, str]:
        """Make what the versions in force lack of token bags, lengths and term counts; the parts to read."""
        parts = self.meta().get("parts", {})
        missing = {b: v for b, v in parts.items() if not self.files.exists(f"{self.home}/lexical_made/{v}")}
        if missing:
            rows = self._table("chunks", T.StructType([CHUNK["chunk_id"], CHUNK["relative_path"], CHUNK["text"], CHUNK["scope"]]), missing)
            version = F.element_at(F.create_map(*[F.lit(x) for pair in missing.items() for x in pair]), self._bucket(F.col("relative_path")).cast("string"))
            placed = rows.withColumns({"bucket": self._bucket(F.col("relative_path")), "version": version})
            by = ("scope", "bucket", "version")
            def write(name: str, made: DataFrame) -> None:
                made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version", "scope").parquet(f"{self.home}/{name}")

            # Sorted by term: a query's terms select row groups by their bounds.
            write("postings", search.postings(placed, by=by).repartition("bucket").sortWithinPartitions(*by, "term"))
            write("lengths", search.lengths(placed, by=by).repartition("bucket"))
            if self.files.exists(f"{self.home}/postings"):
                stored = self.spark.read.schema(T.StructType([*POSTINGS.fields, *_PLACE])).parquet(f"{self.home}/postings").where(F.col("version").isin(list(set(missing.values()))))
                write("vocabulary", stored.groupBy(*by, "term").agg(F.count("*").alias("df")).repartition("bucket"))
            for v in set(missing.values()):
                self.files.write(f"{self.home}/lexical_made/{v}", "")
        return parts

    def postings(self) -> DataFrame:
        """Token bags of exactly the versions in force, made at first use: they cannot go stale."""
        return self._table("postings", POSTINGS, self._lexical())

    def lengths(self) -> DataFrame:
        return self._table("lengths", LENGTHS, self._lexical())

    def vocabulary(self) -> DataFrame:
        """scope, term, df over all buckets."""
        return self._table("vocabulary", VOCABULARY, self._lexical()).groupBy("scope", "term").agg(F.sum("df").alias("df"))

    def lexical_scores(self, query: str, scopes: tuple[str, ...] = SCOPES, keep: Column | None = None) -> DataFrame:
        """(scope, chunk_id, lexical_raw) of all chunks of the scopes that pass the filter, from the stored bags."""
        bags, sizes, vocabulary = self.postings(), self.lengths(), self.vocabulary()
        if keep is not None:  # counts and idf are those of the filtered rows
            ids = self.chunks(vectors=False).where(keep).select("scope", "chunk_id")
            bags, sizes, vocabulary = bags.join(ids, ["scope", "chunk_id"], "left_semi"), sizes.join(ids, ["scope", "chunk_id"], "left_semi"), None
        within = F.col("scope").isin(list(scopes))
        return search.bm25_stored(bags.where(within), sizes.where(within), query, vocabulary=vocabulary if vocabulary is None else vocabulary.where(within))

    # Writing

    @contextmanager
    def locked(self, wait_seconds: float = 600, stale_seconds: float = 3600) -> Iterator[None]:
        self.files.make(self.home)
        lock, until = f"{self.home}/LOCK", time.monotonic() + wait_seconds
        while not self.files.create_alone(lock):
            try:
                if self.files.age_seconds(lock) > stale_seconds:
                    self.files.delete(lock)
                    continue
            except Py4JJavaError:  # it went meanwhile
                continue
            if time.monotonic() > until:
                raise TimeoutError(f"another writer holds {lock}") from None
            time.sleep(0.1)
        try:
            yield
        finally:
            self.files.delete(lock)

    def _bucket(self, path: Column, buckets: int | None = None) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(buckets or self.meta()["buckets"])).cast("int")

    def _write(self, name: str, rows: DataFrame, by: list[str], buckets: int, version: str) -> None:
        placed = rows.withColumns({"bucket": self._bucket(F.col("relative_path"), buckets), "version": F.lit(version)})
        placed.repartition("bucket").write.mode("append").partitionBy("bucket", "version", *by).parquet(f"{self.home}/{name}")

    def _written(self, name: str, schema: T.StructType, version: str, by: list[str]) -> list:
        if not self.files.exists(f"{self.home}/{name}"):
            return []
        rows = self.spark.read.schema(T.StructType([*schema.fields, *_PLACE])).parquet(f"{self.home}/{name}").where(F.col("version") == version)
        return rows.groupBy("bucket", *by).count().collect()  # at most buckets x scopes

    def _put(self, chunks: DataFrame, files: DataFrame, touched: list[int] | None, buckets: int, facts: dict) -> dict:
        """Make the given rows the content of the touched buckets (None: of all) and move the pointer. Call with the lock held."""
        old, version = self.meta(), f"v{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        rows = changes.latest_rows(chunks.select(*CHUNK.fieldNames()), ["chunk_id"], ["mtime_ns", "scope", "start_line"])
        self._write("chunks", rows, ["scope"], buckets, version)
        self._write("files", files.select(*FILES.fieldNames()), [], buckets, version)
        made = self._written("chunks", CHUNK, version, ["scope"])
        gone = set(old.get("parts", {})) if touched is None else {str(b) for b in touched}
        stays = lambda d: {} if touched is None else {b: v for b, v in d.items() if b not in gone}
        bucket_counts = stays(old.get("bucket_counts", {}))
        for r in made:
            bucket_counts.setdefault(str(r["bucket"]), {})[r["scope"]] = r["count"]
        parts = stays(old.get("parts", {})) | {str(r["bucket"]): version for r in made}
        file_parts = stays(old.get("file_parts", {})) | {str(r["bucket"]): version for r in self._written("files", FILES, version, [])}
        change = old.get("change", 0) + 1
        replaced = {f"bucket={b}/version={v}" for name in ("parts", "file_parts") for b, v in old.get(name, {}).items() if v not in ({} if touched is None else {**parts, **file_parts}).get(b, "")}
        retired = [*old.get("retired", []), *([n, p] for n, p in ((change, p) for p in sorted(replaced)))]
        meta = {
            **old,
            **facts,
            "version": version,
            "buckets": buckets,
            "change": change,
            "parts": parts,
            "file_parts": file_parts,
            "bucket_counts": bucket_counts,
            "counts": {s: sum(c.get(s, 0) for c in bucket_counts.values()) for s in SCOPES},
            "retired": [x for x in retired if x[0] > change - self.keep],
        }
        draft = f"{self.home}/CURRENT.{uuid.uuid4().hex}"
        self.files.write(draft, json.dumps(meta, ensure_ascii=False, indent=2))
        self.files.replace(draft, self.pointer)
        for n, place in retired:
            if n <= change - self.keep:
                for name in ("chunks", "files", "postings", "lengths", "vocabulary"):
                    self.files.delete(f"{self.home}/{name}/{place}")
        return meta

    def replace(self, chunks: DataFrame, files: DataFrame, expected_rows: int | None = None, **facts) -> dict:
        """Write all buckets anew and make them current. Call with the lock held. `expected_rows` decides the number of buckets."""
        n = self.meta().get("buckets", 8) if expected_rows is None else max(8, math.ceil(expected_rows / self.bucket_rows))
        return self._put(chunks, files, None, n, facts)

    def change(self, touched: DataFrame, chunks: DataFrame, files: DataFrame) -> dict:
        """Replace the chunks and manifest rows of the touched paths by the given ones, in their buckets only. Call with the lock held."""
        buckets = self.meta().get("buckets", 8)
        named = [r[0] for r in touched.select(self._bucket(F.col("relative_path"), buckets)).distinct().collect()]  # at most the buckets
        of = lambda name: {b: v for b, v in self.meta().get(name, {}).items() if int(b) in named}
        kept = changes.delete_paths(self._chunks(of("parts")), touched)
        known = changes.delete_paths(self._table("files", FILES, of("file_parts")), touched)
        return self._put(kept.unionByName(chunks, allowMissingColumns=True), known.unionByName(files), named, buckets, {})

    def upsert(self, new: DataFrame, files: DataFrame | None = None) -> dict:
        """Add rows, or put them in the place of those with their chunk_id."""
        with self.locked():
            buckets = self.meta().get("buckets", 8)
            named = [r[0] for r in new.select(self._bucket(F.col("relative_path"), buckets)).distinct().collect()]
            of = lambda name: {b: v for b, v in self.meta().get(name, {}).items() if int(b) in named}
            known = self._table("files", FILES, of("file_parts"))
            if files is not None:
                known = changes.delete_paths(known, files).unionByName(files.select(*FILES.fieldNames()))
            return self._put(changes.upsert(self._chunks(of("parts")), new), known, named, buckets, {})

    def delete_paths(self, given: list[str]) -> dict:
        with self.locked():
            return self.change(changes.normal_paths(self.spark, given), self.spark.createDataFrame([], CHUNK), self.spark.createDataFrame([], FILES))

    def count(self, scope: str) -> int:
        return self.meta().get("counts", {}).get(scope, 0)

    def healthcheck(self) -> bool:
        try:
            return self.files.make(self.home.rsplit("/", 1)[0])
        except Py4JJavaError:
            return False
