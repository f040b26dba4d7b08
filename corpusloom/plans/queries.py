"""Registered queries of the core operators. Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.config import Settings
from corpusloom.functions import hashing, paths, text, vectors
from corpusloom.operators import changes, evaluation, search
from corpusloom.operators.chunkers import chunk_files, headings, parts, windows
from corpusloom.plans.oracle import ORACLE  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
QUERY_TEXT = "where the merged window is rebuilt after a restart"
WEIGHTS = Settings()


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def latest_chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The last write of each chunk of a repository."""
    rows = table(spark, d, "chunks").select("repo_key", "chunk_id", "indexed_at", *columns)
    return changes.latest_rows(rows, ["repo_key", "chunk_id"], ["indexed_at"])


def current_files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    rows = table(spark, d, "source_files").select("repo_key", paths.posix(F.col("relative_path")).alias("relative_path"), "mtime_ns", *columns)
    return changes.latest_rows(rows, ["repo_key", "relative_path"], ["mtime_ns"]) if columns else rows.groupBy("repo_key", "relative_path").agg(F.max("mtime_ns").alias("mtime_ns"))


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The vector table in the shape of chunks: label as chunk type, its parity as scope."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("chunk_type"), F.when(F.col("label") % 2 == 0, "code").otherwise("docs").alias("scope"))


def _scores(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# Dense search


@query
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _scores(search.dense_topk(_embeddings(spark, d), _first_vector(spark, d), 10).select("chunk_id", "dense_score"), "dense_score")


@query
def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    found = search.dense_search(_embeddings(spark, d), _first_vector(spark, d), 10, keep=search.chunk_filter(chunk_types=["1", "3", "4"]))
    return _scores(found.select("chunk_id", "scope", "chunk_type", "dense_score"), "dense_score")


@query
def dense_topk_prefiltered(spark: SparkSession, d: str) -> DataFrame:
    found = search.dense_search(_embeddings(spark, d), _first_vector(spark, d), 10, keep=search.chunk_filter(chunk_types=["1", "3", "4"]), prefilter=True)
    return _scores(found.select("chunk_id", "scope", "chunk_type", "dense_score"), "dense_score")


@query
def dense_topk_by_scope(spark: SparkSession, d: str) -> DataFrame:
    found = search.dense_search(_embeddings(spark, d), _first_vector(spark, d), 25)
    return _scores(found.select("chunk_id", "scope", "dense_score"), "dense_score")


@query
def batch_knn(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    queries = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return _scores(search.batch_knn(e, queries, 10, "vec_id", "embedding"), "score")


@query
def find_similar(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    own = e.orderBy(F.desc("chunk_id")).select("chunk_id", "scope", "vector").first()
    near = search.similar_to(e, own["chunk_id"], own["scope"], own["vector"], 10)
    return _scores(near.select("chunk_id", "scope", "dense_score"), "dense_score")


@query
def embed_mean(spark: SparkSession, d: str) -> DataFrame:
    """The mean of each vector with its successor, as for a text embedded in two halves."""
    e = table(spark, d, "embeddings")
    pair = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("_next")), "vec_id")
    mean = vectors.mean(F.col("embedding").cast("array<double>"), F.col("_next").cast("array<double>"))
    return pair.select("vec_id", F.size(mean).alias("dimension"), F.round(F.aggregate(mean, F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(vectors.norm(mean), 6).alias("norm"))


# Lexical and hybrid search


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang")


@query
def tokenize_stats(spark: SparkSession, d: str) -> DataFrame:
    t = text.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"), F.coalesce(F.array_min(t), F.lit("")).alias("least_token"))


@query
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(search.normalise(search.bm25(_documents(spark, d), QUERY_TEXT)), "lexical_raw", "lexical_score")


@query
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).where(F.col("lang") == "en")
    return _scores(search.normalise(search.bm25(rows, QUERY_TEXT)), "lexical_raw", "lexical_score")


@query
def bm25_by_scope(spark: SparkSession, d: str) -> DataFrame:
    """Over the chunks, with the statistics of each scope."""
    rows = latest_chunks(spark, d, "scope", "text").withColumn("chunk_id", F.concat_ws("/", "repo_key", "chunk_id"))
    return _scores(search.normalise(search.bm25(rows, QUERY_TEXT, by=("scope",)), by=("scope",)), "lexical_raw", "lexical_score")


@query
def postings_by_scope(spark: SparkSession, d: str) -> DataFrame:
    bags = search.postings(latest_chunks(spark, d, "scope", "text"), by=("scope",))
    return bags.groupBy("scope", "term").agg(F.countDistinct("chunk_id").alias("df"), F.sum("tf").alias("tf"))


def _hybrid_rows(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d).select("chunk_id", "vector", "scope")
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text").join(e, "chunk_id")


@query
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    found = search.hybrid_search(_hybrid_rows(spark, d), QUERY_TEXT, _first_vector(spark, d), 10)
    return _scores(found, "dense_score", "lexical_score", "score")


@query
def hybrid_fuse(spark: SparkSession, d: str) -> DataFrame:
    rows = _hybrid_rows(spark, d)
    dense = search.dense_search(rows, _first_vector(spark, d), 50)
    lexical = search.normalise(search.bm25(rows, QUERY_TEXT, by=("scope",)), by=("scope",))
    return _scores(search.fuse(dense, lexical), "dense_score", "lexical_score", "score")


# Scalar expressions


@query
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query
def path_features(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("relative_path")
    rows = table(spark, d, "source_files").select("repo_key", paths.posix(p).alias("relative_path")).distinct()
    return rows.select(
        "repo_key",
        "relative_path",
        paths.scope(p).alias("scope"),
        F.array_join(paths.domain_tags(p), ",").alias("domain_tags"),
        paths.language(p).alias("language"),
        paths.is_text_like(p).alias("is_text"),
        paths.should_index(p, WEIGHTS.include_globs, WEIGHTS.exclude_globs).alias("is_indexed"),
    )


@query
def chunk_identity(spark: SparkSession, d: str) -> DataFrame:
    """Hash, id and storage id of the unsplit chunks from their stored columns."""
    rows = latest_chunks(spark, d, "relative_path", "text", "extra", "chunk_type").where(~F.col("chunk_type").endswith("_part"))
    made = hashing.point_id(F.col("relative_path"), F.col("extra")["locator"], F.col("text"))
    return rows.select("repo_key", made.alias("chunk_id"), hashing.content_hash(F.col("text")).alias("content_hash"), hashing.storage_uuid(F.col("chunk_id")).alias("storage_uuid"))


@query
def prompts(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "search_queries")
    return q.select("name", text.query_prompt(F.col("query"), "query: {query}").alias("query_prompt"), text.document_prompt(F.col("query"), "passage: ").alias("document_prompt"))


@query
def payload_bytes(spark: SparkSession, d: str) -> DataFrame:
    rows = latest_chunks(spark, d, "relative_path", "text", "language", "chunk_type", "domain_tags", "scope")
    size = text.payload_bytes(F.col("text"), F.col("relative_path"), F.col("language"), F.col("chunk_type"), F.col("domain_tags"), 64)
    return rows.groupBy("repo_key", "scope").agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))


@query
def collection_names(spark: SparkSession, d: str) -> DataFrame:
    """Table names of each repository and scope. The repositories are a short fixed list."""
    out = []
    for r in table(spark, d, "repositories").collect():
        s = Settings(repo_key=r["repo_key"], profile_name=r["profile_name"], embedding_model=r["embedding_model"], index_schema_version=r["index_schema_version"])
        out += [(r["repo_key"], scope, s.table_name(scope)) for scope in ("code", "docs")]
    return spark.createDataFrame(out, "repo_key string, scope string, name string")


# Chunkers


@query
def chunk_current_files(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of the current files of every repository, oversized ones split where the repository says so."""
    files = current_files(spark, d, "content")
    repositories = table(spark, d, "repositories").select("repo_key", F.col("split_oversized").alias("split"))
    found = chunk_files(files.join(F.broadcast(repositories), "repo_key"), Settings(legacy_lines=True, safe_excludes=False), ("repo_key",))
    columns = ["repo_key", "chunk_id", "scope", "relative_path", "language", "chunk_type", "text", "start_line", "end_line", "content_hash", "symbol_path", "heading_path"]
    return found.select(*columns, F.array_join("domain_tags", ",").alias("domain_tags"), F.col("extra")["locator"].alias("locator"), F.col("extra")["split_part"].alias("split_part")).distinct()


@query
def generic_windows(spark: SparkSession, d: str) -> DataFrame:
    def run(batches):
        import pandas as pd

        for b in batches:
            out = [(i, s.start_line, s.end_line, len(s.text)) for i, t in zip(b["doc_id"], b["text"]) for s in windows(t)]
            yield pd.DataFrame(out, columns=["doc_id", "start_line", "end_line", "n_chars"])

    return table(spark, d, "documents").select("doc_id", "text").where(F.col("text").isNotNull()).mapInPandas(run, "doc_id bigint, start_line int, end_line int, n_chars int")


@query
def oversized_parts(spark: SparkSession, d: str) -> DataFrame:
    def run(batches):
        import pandas as pd

        for b in batches:
            out = [(i, max(1, p.number), len(p.text), p.start_line, p.end_line) for i, t in zip(b["doc_id"], b["text"]) for p in parts(t, 1, t.count("\n") + 1)]
            yield pd.DataFrame(out, columns=["doc_id", "part", "n_chars", "start_line", "end_line"])

    return table(spark, d, "documents").select("doc_id", "text").where(F.col("text").isNotNull()).mapInPandas(run, "doc_id bigint, part int, n_chars int, start_line int, end_line int")


@query
def heading_paths(spark: SparkSession, d: str) -> DataFrame:
    """Headings of all documents with the path of their ancestors, as the section chunker reads them."""

    def run(batches):
        import pandas as pd

        for b in batches:
            out = [(i, *h) for i, t in zip(b["doc_id"], b["text"]) for h in headings(t.splitlines())]
            yield pd.DataFrame(out, columns=["doc_id", "line_no", "level", "heading_path"])

    return table(spark, d, "documents").select("doc_id", "text").where(F.col("text").isNotNull()).mapInPandas(run, "doc_id bigint, line_no int, level int, heading_path string")


# Index changes


@query
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = latest_chunks(spark, d, "relative_path", "text", "start_line", "end_line")
    return rows.select("repo_key", "chunk_id", "relative_path", "start_line", "end_line", F.md5("text").alias("text_md5"), "indexed_at")


@query
def delete_stale(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that stay when the paths that changed or went are deleted from the index, in one anti join."""
    chunks = latest_chunks(spark, d, "scope", "relative_path", "source_mtime")
    touched = changes.reconcile(changes.indexed_paths(chunks, ("repo_key",)), current_files(spark, d), ("repo_key",))
    kept = changes.delete_paths(chunks, touched, ("repo_key", "relative_path"))
    return kept.groupBy("repo_key", "scope").agg(F.count("*").alias("n"), F.countDistinct("relative_path").alias("n_paths"))


@query
def reconcile_diff(spark: SparkSession, d: str) -> DataFrame:
    chunks = latest_chunks(spark, d, "scope", "relative_path", "source_mtime")
    return changes.reconcile(changes.indexed_paths(chunks, ("repo_key",)), current_files(spark, d), ("repo_key",))


@query
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """The files crawled in the first half of the time against those crawled in the second."""
    rows = table(spark, d, "source_files").select("repo_key", paths.posix(F.col("relative_path")).alias("relative_path"), "mtime_ns", F.unix_micros("crawled_at").alias("at"))
    middle = rows.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).select(F.expr("lo + (hi - lo) div 2").alias("middle"))
    both = rows.join(F.broadcast(middle), how="left")
    half = lambda keep: both.where(keep).groupBy("repo_key", "relative_path").agg(F.max("mtime_ns").alias("mtime_ns"))
    return changes.snapshot_diff(half(F.col("at") <= F.col("middle")), half(F.col("at") > F.col("middle")), ("repo_key", "relative_path"))


@query
def index_status(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("repo_key", "chunk_id", "indexed_at", "scope", "relative_path", F.col("vector").isNotNull().alias("embedded"))  # no vector is shuffled
    chunks = changes.latest_rows(rows, ["repo_key", "chunk_id"], ["indexed_at"])
    by = chunks.groupBy("repo_key", "scope").agg(F.count("*").alias("points"), F.countDistinct("relative_path").alias("paths"), F.count_if("embedded").alias("embedded"), F.max("indexed_at").alias("last_indexed_at"))
    return by.join(F.broadcast(table(spark, d, "repositories").select("repo_key", "profile_name", "embedding_backend", "index_schema_version", "watch_enabled", "last_full_build_at")), "repo_key")


# Results and evaluation


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Logged results, each once."""
    rows = table(spark, d, "search_results")
    return changes.latest_rows(rows, ["run_label", "query_name", "repo_key", "served_at", "position_no"], ["logged_at"])


@query
def dedup_results(spark: SparkSession, d: str) -> DataFrame:
    """The best score of each chunk for a run and query, ranked anew."""
    keys = ("run_label", "query_name", "repo_key", "chunk_id")
    rows = search.best_by_id(table(spark, d, "search_results").select(*keys, "score"), "score", keys)
    rank = F.row_number().over(Window.partitionBy("run_label", "query_name", "repo_key").orderBy(F.desc_nulls_last("score"), "chunk_id"))
    return _scores(rows.withColumn("rank", rank), "score")


@query
def fused_results(spark: SparkSession, d: str) -> DataFrame:
    """The logged sides of each result fused anew; a missing side counts 0."""
    rows = _results(spark, d)
    fused = search.fused_score(F.col("dense_score"), F.col("lexical_score"))
    return rows.select("run_label", "query_name", "repo_key", "served_at", "position_no", "chunk_id", fused.alias("fused"))


@query
def hit_at_k(spark: SparkSession, d: str) -> DataFrame:
    chunks = latest_chunks(spark, d, "scope", "relative_path").select("repo_key", "scope", "chunk_id", "relative_path")
    found = table(spark, d, "search_results").join(chunks, ["repo_key", "scope", "chunk_id"]).select("run_label", F.col("query_name").alias("name"), "relative_path", F.col("position_no").alias("position"))
    return evaluation.hit_at_k(found, table(spark, d, "search_queries").select("name", "expected_any"), 3, ("run_label",))


@query
def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.compare_runs(table(spark, d, "search_results"))


from corpusloom.plans import index_queries  # noqa: E402

QUERIES |= index_queries.QUERIES
