"""Registered queries that go through the chunk store and the engine. Each runs over its whole tables."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import Settings
from corpusloom.functions import paths
from corpusloom.operators import changes, search
from corpusloom.plans.engine import Engine
from corpusloom.plans.shared import own_folder
from corpusloom.plans.store import FILES, ChunkStore
from corpusloom.schemas import CHUNK, RESULT_COLUMNS
from corpusloom.sources.crawl import query_set

_STORES: dict[tuple[str, str], ChunkStore] = {}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _stored_rows(spark: SparkSession, d: str) -> DataFrame:
    """The chunk table in the shape of the store: all repositories in one index, so ids and paths begin with the repository."""
    rows = _table(spark, d, "chunks")
    inside = lambda c: F.concat_ws("/", "repo_key", c)
    named = rows.withColumns({"chunk_id": inside(F.col("chunk_id")), "relative_path": inside(paths.posix(F.col("relative_path"))), "mtime_ns": F.round(F.col("source_mtime") * 1_000_000).cast("bigint") * 1000})
    return named.select(*CHUNK.fieldNames(), "indexed_at")


def _latest(rows: DataFrame) -> DataFrame:
    return changes.latest_rows(rows, ["chunk_id"], ["indexed_at"]).drop("indexed_at")


def _no_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FILES)


def _new_store(spark: SparkSession) -> ChunkStore:
    return ChunkStore(spark, own_folder(spark, "store"), Settings(repo_key="all"))


def _store(spark: SparkSession, d: str) -> ChunkStore:
    """A store written in two steps: the rows indexed in the first half of the time, then an upsert of the later ones. Made once for a program."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORES:
        store, rows = _new_store(spark), _stored_rows(spark, d)
        lo, hi = rows.agg(F.min(F.unix_micros("indexed_at")), F.max(F.unix_micros("indexed_at"))).first()
        early = F.unix_micros("indexed_at") <= ((lo or 0) + (hi or 0)) // 2
        with store.locked():
            store.replace(_latest(rows.where(early)), _no_files(spark), rows.count())
        store.upsert(_latest(rows.where(~early)))
        _STORES[key] = store
    return _STORES[key]


def store_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every stored row without its vector."""
    rows = _store(spark, d).chunks(vectors=False)
    plain = ["chunk_id", "scope", "relative_path", "language", "chunk_type", "start_line", "end_line", "content_hash", "symbol_path", "heading_path", "is_generated", "embedding_backend", "embedding_model", "index_schema_version"]
    return rows.select(*plain, F.md5("text").alias("text_md5"), F.array_join("domain_tags", ",").alias("domain_tags"), F.col("extra")["locator"].alias("locator"), F.round("source_mtime", 3).alias("source_mtime"))


def store_vectors(spark: SparkSession, d: str) -> DataFrame:
    """What the upsert left of the vectors, by scope."""
    rows = _store(spark, d).chunks()
    return rows.groupBy("scope").agg(F.count("*").alias("points"), F.count("vector").alias("embedded"), F.round(F.sum(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)), 3).alias("total"))


def store_status(spark: SparkSession, d: str) -> DataFrame:
    """The collections of the index status, as the engine reports them."""
    engine = _engine(spark, d)
    return spark.createDataFrame([(c["scope"], c["name"], c["exists"], c["points"]) for c in engine.index_status()["collections"]], "scope string, name string, exists boolean, points bigint")


def store_recreated(spark: SparkSession, d: str) -> DataFrame:
    """Counts after all rows are replaced by the docs alone: the other scope is empty."""
    store, rows = _new_store(spark), _latest(_stored_rows(spark, d))
    with store.locked():
        store.replace(rows, _no_files(spark))
    with store.locked():
        store.replace(rows.where("scope = 'docs'"), _no_files(spark))
    return spark.createDataFrame([(s, store.count(s), store.exists(s)) for s in ("code", "docs")], "scope string, points bigint, exists boolean")


def store_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by scope after the paths that changed or went since they were indexed are deleted, in their buckets alone."""
    store, rows = _new_store(spark), _latest(_stored_rows(spark, d))
    with store.locked():
        store.replace(rows, _no_files(spark))
    files = _table(spark, d, "source_files").select(F.concat_ws("/", "repo_key", paths.posix(F.col("relative_path"))).alias("relative_path"), "mtime_ns").groupBy("relative_path").agg(F.max("mtime_ns").alias("mtime_ns"))
    touched = changes.reconcile(changes.indexed_paths(rows), files).select("relative_path")
    with store.locked():
        store.change(touched, spark.createDataFrame([], CHUNK), _no_files(spark))
    return store.chunks(vectors=False).groupBy("scope").agg(F.count("*").alias("n"), F.countDistinct("relative_path").alias("n_paths"))


def read_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Lookup of the chunks that the searches returned, by scope and id; ids that are gone give no row."""
    wanted = _table(spark, d, "search_results").select("scope", F.concat_ws("/", "repo_key", "chunk_id").alias("chunk_id"))
    found = _store(spark, d).lookup(wanted)
    part = lambda c, n: F.regexp_extract(c, "^([^/]*)/(.*)$", n)
    return found.select(part("chunk_id", 1).alias("repo_key"), "scope", part("chunk_id", 2).alias("chunk_id"), part("relative_path", 2).alias("relative_path"), "chunk_type", "start_line", "end_line", F.md5("text").alias("text_md5"))


def stored_bm25(spark: SparkSession, d: str) -> DataFrame:
    """BM25 of each scope from the stored token bags."""
    from corpusloom.plans.queries import QUERY_TEXT

    scored = search.normalise(_store(spark, d).lexical_scores(QUERY_TEXT), by=("scope",))
    return scored.withColumns({c: F.round(c, 6) for c in ("lexical_raw", "lexical_score")})


def _least_vector(store: ChunkStore) -> tuple[str, str, list[float]]:
    own = store.chunks().where(F.col("vector").isNotNull()).orderBy("chunk_id").select("chunk_id", "scope", "vector").first()
    return own["chunk_id"], own["scope"], list(own["vector"])


def find_similar_stored(spark: SparkSession, d: str) -> DataFrame:
    """The engine's neighbours of the first chunk by its stored vector."""
    cid, scope, _ = _least_vector(_store(spark, d))
    return _engine(spark, d).find_similar_chunk(scope, cid, 10, stored_vector=True).select("chunk_id", "scope", F.round("score", 6).alias("score"))


def dense_by_path_and_tag(spark: SparkSession, d: str) -> DataFrame:
    """The nearest chunks to the first one's vector below a folder and with one of two tags, filtered after the shortlist."""
    store = _store(spark, d)
    cid, _, vector = _least_vector(store)
    keep = search.chunk_filter(path_prefix=cid.split("/")[0] + "\\", domain_tags=["general", "docs"])
    found = search.dense_search(store.chunks(), vector, 25, keep=keep, overfetch=40)
    return found.select("chunk_id", "scope", F.round("dense_score", 6).alias("dense_score"))


def result_projection(spark: SparkSession, d: str) -> DataFrame:
    """The compact result rows of the hundred best logged results."""
    best = search.best_by_id(_table(spark, d, "search_results").select(F.concat_ws("/", "repo_key", "chunk_id").alias("chunk_id"), "scope", "score", "dense_score", "lexical_score"), "score")
    chunks = _store(spark, d).chunks(vectors=False)
    ranked = best.join(chunks.select("chunk_id", "scope"), ["chunk_id", "scope"]).orderBy(F.desc("score"), "chunk_id").limit(100).select("chunk_id", "score")
    sides = {c: F.lit(None).cast("double") for c in ("dense_score", "lexical_score")}
    rows = search.result_rows(ranked.withColumns(sides), chunks)
    return rows.select(*[c for c in RESULT_COLUMNS if c not in ("domain_tags", "dense_score", "lexical_score")], F.array_join("domain_tags", ",").alias("domain_tags"))


# A tree of files, indexed and tracked


def _write_tree(files: DataFrame, root: str) -> None:
    def run(rows):
        for r in rows:
            full = os.path.join(root, r["relative_path"])
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "wb") as f:
                f.write(r["content"] or b"")
            os.utime(full, ns=(r["mtime_ns"], r["mtime_ns"]))

    files.select("relative_path", "content", "mtime_ns").where(F.col("mtime_ns").isNotNull() & paths.is_confined(F.col("relative_path"))).foreachPartition(run)


def _tree_files(rows: DataFrame) -> DataFrame:
    """One tree of all repositories: of a path in several, the newest, then the last by name."""
    named = rows.select(paths.posix(F.col("relative_path")).alias("relative_path"), "mtime_ns", "repo_key", "content")
    return changes.latest_rows(named, ["relative_path"], ["mtime_ns", "repo_key"])


def tracked_tree(spark: SparkSession, d: str) -> DataFrame:
    """A tree as crawled in the first half of the time is indexed, brought to its present state and reconciled: what is then indexed.

    One row a path and scope: the places of its chunks and a digest of their contents; parts count with their whole.
    """
    rows = _table(spark, d, "source_files")
    lo, hi = rows.agg(F.min(F.unix_micros("crawled_at")), F.max(F.unix_micros("crawled_at"))).first()
    root = re.sub("^file:/*", "/", own_folder(spark, "tree"))
    os.makedirs(root, exist_ok=True)
    settings = Settings(repo_root=root, repo_key="tracked", safe_excludes=False, legacy_lines=True)
    engine = Engine(spark, own_folder(spark, "store"), settings)
    _write_tree(_tree_files(rows.where(F.unix_micros("crawled_at") <= ((lo or 0) + (hi or 0)) // 2)), root)
    _write_tree(spark.createDataFrame([("docs/gone.md", bytearray(b"# Gone\n"), 1)], "relative_path string, content binary, mtime_ns bigint"), root)
    engine.rebuild_index()
    os.remove(os.path.join(root, "docs/gone.md"))
    _write_tree(_tree_files(rows), root)
    engine.reconcile_index()
    return (
        engine.store.chunks(vectors=False)
        .groupBy("relative_path", "scope")
        .agg(F.countDistinct(F.col("extra")["locator"]).alias("n_places"), F.md5(F.array_join(F.sort_array(F.collect_set("content_hash")), ",")).alias("contents"))
    )


def query_set_file(spark: SparkSession, d: str) -> DataFrame:
    """The query set written as the JSON array that evaluations read, and read again. It is a short fixed list."""
    folder = re.sub("^file:/*", "/", own_folder(spark, "queries"))
    os.makedirs(folder, exist_ok=True)
    rows = [r.asDict() for r in _table(spark, d, "search_queries").select("name", "query", "expected_any").collect()]
    with open(os.path.join(folder, "queries.json"), "w") as f:
        json.dump(rows, f, ensure_ascii=False, indent=2)
    return query_set(spark, os.path.join(folder, "queries.json")).select("name", "query", F.array_join("expected_any", "|").alias("expected_any"))


def index_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The profile name of each repository's index and its configuration as JSON. The repositories are a short fixed list."""
    out = []
    for r in _table(spark, d, "repositories").collect():
        s = Settings.load({"CORPUSLOOM_PROFILE_NAME": r["profile_name"] or "", "CORPUSLOOM_REPO_KEY": r["repo_key"], "CORPUSLOOM_EMBEDDING_MODEL": r["embedding_model"], "CORPUSLOOM_INDEX_SCHEMA_VERSION": str(r["index_schema_version"])})
        out.append((r["repo_key"], s.index_profile(), json.loads(json.dumps(vars(s)))["index_schema_version"]))
    return spark.createDataFrame(out, "repo_key string, profile string, index_schema_version int")


# The search tools of the engine


def _engine(spark: SparkSession, d: str) -> Engine:
    store = _store(spark, d)
    return Engine(spark, store.home.rsplit("/", 1)[0], store.settings)


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("chunk_id", "scope", "relative_path", *[F.round(c, 6).alias(c) for c in ("score", "dense_score", "lexical_score")])


def tool_semantic_search(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.plans.queries import QUERY_TEXT

    return _ranked(_engine(spark, d).semantic_search(QUERY_TEXT, top_k=20))


def tool_semantic_search_code(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.plans.queries import QUERY_TEXT

    return _ranked(_engine(spark, d).semantic_search_code(QUERY_TEXT, top_k=20, chunk_types=["python_function", "generic_window"]))


def tool_semantic_search_docs(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.plans.queries import QUERY_TEXT

    return _ranked(_engine(spark, d).semantic_search_docs(QUERY_TEXT, top_k=20, domain_tags=["docs", "observability"]))


def tool_hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.plans.queries import QUERY_TEXT

    return _ranked(_engine(spark, d).hybrid_search(QUERY_TEXT, top_k=20))


def tool_hybrid_search_code(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.plans.queries import QUERY_TEXT

    return _ranked(_engine(spark, d).hybrid_search_code(QUERY_TEXT, top_k=20, chunk_types=["python_function", "generic_window"]))


def tool_hybrid_search_docs(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.plans.queries import QUERY_TEXT

    return _ranked(_engine(spark, d).hybrid_search_docs(QUERY_TEXT, top_k=20, domain_tags=["docs", "observability"]))


def tool_read_chunk(spark: SparkSession, d: str) -> DataFrame:
    """The first chunk, read by the tool."""
    cid, scope, _ = _least_vector(_store(spark, d))
    return _engine(spark, d).read_chunk(scope, cid).select("chunk_id", "scope", "relative_path", "language", "chunk_type", F.md5("text").alias("text_md5"), "start_line", "end_line", "symbol_path", "heading_path", F.array_join("domain_tags", ",").alias("domain_tags"))


QUERIES = {
    f.__name__: f
    for f in (store_scan, store_vectors, store_status, store_recreated, store_deleted, read_chunks, stored_bm25, find_similar_stored, dense_by_path_and_tag, result_projection, tracked_tree, query_set_file, index_profiles, tool_semantic_search, tool_semantic_search_code, tool_semantic_search_docs, tool_hybrid_search, tool_hybrid_search_code, tool_hybrid_search_docs, tool_read_chunk)
}
