"""The service surface: search, lookup, indexing and status, each returning DataFrames or plain dicts."""

from __future__ import annotations

import json
import logging
import sys
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import Settings
from corpusloom.operators import changes, embedding, search
from corpusloom.operators.chunkers import chunk_files
from corpusloom.plans.store import SCOPES, ChunkStore
from corpusloom.schemas import READ_COLUMNS, RESULT_COLUMNS
from corpusloom.sources.crawl import crawl, read_paths

log = logging.getLogger("corpusloom")


class JsonLines(logging.Formatter):
    """One JSON object a line: time, level, event and the fields given as `extra={"fields": {...}}`."""

    def format(self, record: logging.LogRecord) -> str:
        row = {"ts": datetime.fromtimestamp(record.created, timezone.utc).isoformat(), "level": record.levelname.lower(), "event": record.getMessage(), **getattr(record, "fields", {})}
        return json.dumps(row, ensure_ascii=False, default=str)


def log_to_stderr(level: str = "info") -> None:
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(JsonLines())
    log.handlers[:] = [handler]
    log.setLevel(level.upper())


def scopes_of(scope: str) -> tuple[str, ...]:
    if scope == "all":
        return SCOPES
    if scope not in SCOPES:
        raise ValueError(f"unknown scope: {scope}")
    return (scope,)


class Engine:
    def __init__(self, spark: SparkSession, store_root: str, settings: Settings):
        self.spark, self.settings = spark, settings
        self.store = ChunkStore(spark, store_root, settings)
        self.provider = embedding.provider(settings)
        self.watcher = None

    # Search

    def semantic_search(self, query: str, top_k: int = 10, scope: str = "all", path_prefix: str | None = None, chunk_types: list[str] | None = None, domain_tags: list[str] | None = None, prefilter: bool = False) -> DataFrame:
        return self._dense(self.provider.embed_query(query), top_k, scope, search.chunk_filter(path_prefix, chunk_types, domain_tags), prefilter)

    def semantic_search_code(self, query: str, **given) -> DataFrame:
        return self.semantic_search(query, scope="code", **given)

    def semantic_search_docs(self, query: str, **given) -> DataFrame:
        return self.semantic_search(query, scope="docs", **given)

    def hybrid_search(self, query: str, top_k: int = 10, scope: str = "all", path_prefix: str | None = None, chunk_types: list[str] | None = None, domain_tags: list[str] | None = None) -> DataFrame:
        """BM25 reads the stored token bags of the versions in force; no text is tokenised."""
        filtered = bool(path_prefix or chunk_types or domain_tags)
        keep = search.chunk_filter(path_prefix, chunk_types, domain_tags)
        scopes = scopes_of(scope)
        lexical = self.store.lexical_scores(query, scopes, keep if filtered else None)
        ranked = search.hybrid_search(self.store.chunks(), query, self.provider.embed_query(query), top_k, scopes, keep, self.settings, lexical)
        return search.result_rows(ranked, self.store.chunks(vectors=False), self.settings.snippet_chars)

    def hybrid_search_code(self, query: str, **given) -> DataFrame:
        return self.hybrid_search(query, scope="code", **given)

    def hybrid_search_docs(self, query: str, **given) -> DataFrame:
        return self.hybrid_search(query, scope="docs", **given)

    def _dense(self, vector: list[float], top_k: int, scope: str, keep, prefilter: bool = False) -> DataFrame:
        s = self.settings
        found = search.dense_search(self.store.chunks(), vector, top_k, scopes_of(scope), keep, s.overfetch, s.overfetch_floor, prefilter)
        shown = found.select("*", search.text.snippet(F.col("text"), s.snippet_chars).alias("snippet"), F.col("dense_score").alias("score"), F.lit(None).cast("double").alias("lexical_score"))
        return shown.select(*RESULT_COLUMNS).orderBy(F.desc("score"), "chunk_id")

    def read_chunk(self, scope: str, chunk_id: str) -> DataFrame:
        """No row or one; scope `all` is refused."""
        if scope not in SCOPES:
            raise ValueError("read_chunk needs the scope code or docs")
        return self.store.chunk(scope, chunk_id).select(*READ_COLUMNS)

    def find_similar_chunk(self, scope: str, chunk_id: str, top_k: int = 10, stored_vector: bool = False) -> DataFrame:
        """Neighbours of a chunk in its scope: its text is embedded as a query, or with `stored_vector` its own vector is used."""
        if scope not in SCOPES:
            raise ValueError("find_similar_chunk needs the scope code or docs")
        own = self.store.chunks(scope).where(F.col("chunk_id") == chunk_id).select("text", "vector").first()
        if own is None:
            return self._dense([0.0], 1, scope, F.lit(False))
        vector = own["vector"] if stored_vector else self.provider.embed_query(own["text"])
        near = self._dense(list(vector), top_k + 1, scope, F.lit(True))
        return near.where(F.col("chunk_id") != chunk_id).orderBy(F.desc("score"), "chunk_id").limit(top_k)

    # Indexing

    def _embedded(self, files: DataFrame) -> DataFrame:
        return embedding.embed_chunks(chunk_files(files, self.settings), self.settings)

    @staticmethod
    def _manifest(files: DataFrame) -> DataFrame:
        return files.select("relative_path", "mtime_ns", F.sha2("content", 256).alias("file_hash"))

    def rebuild_index(self) -> dict:
        """Everything anew in one swap; a scope without chunks becomes empty."""
        files = crawl(self.spark, self.settings.repo_root, self.settings)
        # A file makes a few chunks; its bytes are not read for this.
        rows = 4 * crawl(self.spark, self.settings.repo_root, self.settings, content=False).count()
        with self.store.locked():
            meta = self.store.replace(self._embedded(files), self._manifest(files), rows, last_full_build_at=datetime.now(timezone.utc).isoformat())
        log.info("rebuilt", extra={"fields": meta["counts"]})
        return {"rebuild": meta["counts"], "status": self.index_status()}

    def reindex_paths(self, given: list[str]) -> dict:
        """Drop the chunks of the given paths in both scopes and index the files that are there, in one swap."""
        return self.reindex(changes.normal_paths(self.spark, given))

    def reindex(self, touched: DataFrame) -> dict:
        """As `reindex_paths`, for a frame of relative paths of any number. Only these files are opened, only their buckets written."""
        held = f"{self.store.home}/pending/{uuid.uuid4().hex}"
        touched.select("relative_path").distinct().write.parquet(held)  # the tree may change while it is read
        try:
            touched = self.spark.read.schema("relative_path string").parquet(held)
            files = read_paths(touched, self.settings.repo_root, self.settings)
            with self.store.locked():
                meta = self.store.change(touched, self._embedded(files), self._manifest(files))
        finally:
            self.store.files.delete(held)
        return {"counts": meta["counts"]}

    def reconcile_index(self, by_hash: bool = False) -> dict:
        """Index again what differs from the tree; nothing is written when nothing does. Returns the paths, as the tool reports them."""
        current = self._manifest(crawl(self.spark, self.settings.repo_root, self.settings, content=by_hash))
        indexed = self.store.manifest()
        touched = changes.reconcile(indexed, current, by_hash=True) if by_hash else changes.snapshot_diff(indexed, current)
        held = f"{self.store.home}/pending/{uuid.uuid4().hex}"
        touched.select("relative_path").write.parquet(held)
        try:
            touched = self.spark.read.schema("relative_path string").parquet(held)
            if not touched.isEmpty():
                self.reindex(touched)
            return {"touched": sorted(r["relative_path"] for r in touched.collect())}
        finally:
            self.store.files.delete(held)

    def boot(self, attempts: int = 90, pause_seconds: float = 2.0) -> dict:
        """Wait for the services, then rebuild an empty index (if so set) or reconcile a filled one."""
        for n in range(attempts):
            if self.store.healthcheck() and self.provider.healthcheck():
                break
            if n + 1 == attempts:
                raise TimeoutError("the embedding service or the store is not ready")
            time.sleep(pause_seconds)
        if sum(self.store.count(s) for s in SCOPES):
            return self.reconcile_index()
        return self.rebuild_index() if self.settings.auto_index_on_start else {}

    # Status

    def index_status(self) -> dict:
        meta, s = self.store.meta(), self.settings
        return {
            "repo_key": s.key,
            "profile": s.index_profile(),
            "embedding_backend": s.embedding_backend,
            "embedding_model": s.embedding_model,
            "index_schema_version": s.index_schema_version,
            "last_full_build_at": meta.get("last_full_build_at"),
            "watcher_running": bool(self.watcher and self.watcher.is_running()),
            "collections": [{"scope": scope, "name": s.table_name(scope), "exists": self.store.exists(scope), "points": self.store.count(scope)} for scope in SCOPES],
        }

    def resource(self, uri: str) -> str:
        """index://status, index://collections and index://config as JSON."""
        status = self.index_status()
        body = {"index://status": status, "index://collections": status["collections"], "index://config": vars(self.settings)}
        if uri not in body:
            raise KeyError(uri)
        return json.dumps(body[uri], ensure_ascii=False, indent=2, default=str)
