"""Exact dense search, BM25 and their fusion, each one Spark plan."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import paths, text, vectors

K1, B, EPSILON = 1.5, 0.75, 0.25  # the published defaults of BM25 Okapi


def chunk_filter(path_prefix: str | None = None, chunk_types: list[str] | None = None, domain_tags: list[str] | None = None, with_parts: bool = False) -> Column:
    """Conjunction of the given filters; an empty one filters nothing. `with_parts` lets a type match its `_part` too."""
    keep = F.lit(True)
    if path_prefix:
        keep = keep & paths.posix(F.col("relative_path")).startswith(path_prefix.replace("\\", "/"))
    if chunk_types:
        keep = keep & F.col("chunk_type").isin([*chunk_types, *(f"{t}_part" for t in chunk_types if with_parts)])
    if domain_tags:
        keep = keep & F.arrays_overlap("domain_tags", F.array(*map(F.lit, domain_tags)))
    return keep


def dense_topk(rows: DataFrame, query: list[float], k: int, id_column: str = "chunk_id", vector_column: str = "vector") -> DataFrame:
    """The k rows of highest cosine, ties by id: a scan with a bounded heap a partition, no shuffle of rows."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.withColumn("dense_score", vectors.cosine(F.col(vector_column), q)).where(F.col("dense_score").isNotNull())
    return scored.orderBy(F.desc("dense_score"), id_column).limit(k)


def dense_search(rows: DataFrame, query: list[float], top_k: int = 10, scopes: tuple[str, ...] = ("code", "docs"), keep: Column | None = None, overfetch: int = 6, floor: int = 30, prefilter: bool = False) -> DataFrame:
    """Per scope the nearest max(top_k * overfetch, floor), then the filter, then the best per id, then top_k.

    The filter acts after the shortlist, so fewer than top_k may remain; `prefilter` puts it first instead.
    """
    keep = F.lit(True) if keep is None else keep
    n = max(top_k * overfetch, floor)
    lists = [dense_topk(rows.where((F.col("scope") == s) & keep) if prefilter else rows.where(F.col("scope") == s), query, n) for s in scopes]
    found = lists[0]
    for other in lists[1:]:
        found = found.unionByName(other)
    return best_by_id(found.where(keep)).orderBy(F.desc("dense_score"), "chunk_id").limit(top_k)


def similar_to(rows: DataFrame, chunk_id, scope: str, vector: list[float], top_k: int = 10) -> DataFrame:
    """The nearest other chunks of a scope to a chunk's vector."""
    near = dense_search(rows, vector, top_k + 1, (scope,))
    return near.where(F.col("chunk_id") != chunk_id).orderBy(F.desc("dense_score"), "chunk_id").limit(top_k)


def batch_knn(rows: DataFrame, queries: DataFrame, k: int, id_column: str, vector_column: str, query_id: str = "query_id", query_vector: str = "query_vector", block: int = 256, most_blocks: int = 64) -> DataFrame:
    """query_id, id, score, rank: the k nearest rows of every query, exact, without a cross join.

    Queries are packed into matrices of `block` vectors, and each pass over the rows scores at most
    `most_blocks` of them as one matrix product a batch; partial top lists meet in one shuffle.
    """
    packs = queries.select(query_id, query_vector).where(F.col(query_vector).isNotNull())
    n = packs.count()
    passes = max(1, math.ceil(n / (block * most_blocks)))
    found = None
    for p in range(passes):
        part = packs.where(F.pmod(F.xxhash64(query_id), F.lit(passes)) == p) if passes > 1 else packs
        taken = [(r[0], r[1]) for r in part.collect()]  # at most about block * most_blocks vectors
        kind = dict(packs.dtypes)[query_id]
        scores = rows.select(id_column, vector_column).where(F.col(vector_column).isNotNull()).mapInPandas(_score_batches(taken, k, block, id_column, vector_column), f"query_id {kind}, id {dict(rows.dtypes)[id_column]}, score double")
        found = scores if found is None else found.unionByName(scores)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _score_batches(taken: list[tuple], k: int, block: int, id_column: str, vector_column: str):
    def run(batches):
        import numpy as np
        import pandas as pd

        ids = np.array([i for i, _ in taken], dtype=object)
        matrix = np.array([v for _, v in taken], dtype=np.float64)
        if len(matrix):
            matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        for batch in batches:
            if not len(batch) or not len(matrix):
                continue
            own = np.array(list(batch[vector_column]), dtype=np.float64)
            size = np.linalg.norm(own, axis=1, keepdims=True)
            own, keys = (own / np.where(size > 0, size, 1))[size[:, 0] > 0], batch[id_column].to_numpy()[size[:, 0] > 0]
            for at in range(0, len(matrix), block):
                cos = matrix[at : at + block] @ own.T
                if cos.shape[1] > k:
                    cut = np.partition(cos, cos.shape[1] - k, axis=1)[:, -k][:, None]
                    r, c = np.nonzero(cos >= cut)
                else:
                    r, c = np.nonzero(np.ones_like(cos, dtype=bool))
                yield pd.DataFrame({"query_id": ids[at + r], "id": keys[c], "score": cos[r, c]})

    return run


def spread(rows: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores (one small file) is dealt out; a larger one keeps its own splits.

    Behind a shuffle the rows stay as they are: to ask for their partitions would run it.
    """
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    if any(x in plan for x in ("Aggregate", "Join", "Repartition", "Window", "Sort", "Distinct")):
        return rows
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= n else rows.repartition(n)


def postings(rows: DataFrame, id_column: str = "chunk_id", text_column: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., id, term, tf, dl): the token bags, ready to be stored and read by many queries."""
    bags = rows.select(*by, id_column, text.tokens(F.coalesce(text_column, F.lit(""))).alias("_t"))
    return bags.select(*by, id_column, F.size("_t").alias("dl"), F.explode("_t").alias("term")).groupBy(*by, id_column, "dl", "term").agg(F.count("*").alias("tf"))


def lengths(rows: DataFrame, id_column: str = "chunk_id", text_column: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., id, dl) of every row, also of those without a token."""
    return rows.select(*by, id_column, F.size(text.tokens(F.coalesce(text_column, F.lit("")))).alias("dl"))


_ROWS = "\0"  # stands in the vocabulary for the rows themselves; no token has this character


def _idf_table(vocabulary: DataFrame, corpus: DataFrame, words: Counter, grouped: list[str]) -> DataFrame:
    """(grouped..., n, avgdl, weight): one row a group with the idf of the query's terms, times their number in it, as a map.

    A term in more than half of the rows has the floor EPSILON * mean idf over the whole vocabulary.
    """
    raw = vocabulary.join(F.broadcast(corpus), grouped).withColumn("raw_idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    asked = F.collect_list(F.when(F.col("term").isin(list(words) or [""]), F.struct("term", "raw_idf")))  # at most the query's terms
    means = raw.groupBy(*grouped).agg(F.avg("raw_idf").alias("mean_idf"), asked.alias("asked"))
    times = F.create_map(*[F.lit(x) for word, n in sorted(words.items()) for x in (word, float(n))]) if words else F.lit(None).cast("map<string,double>")
    idf = F.transform("asked", lambda x: F.struct(x["term"], times[x["term"]] * F.when(x["raw_idf"] >= 0, x["raw_idf"]).otherwise(EPSILON * F.col("mean_idf"))))
    return corpus.join(means.select(*grouped, F.map_from_entries(idf).alias("weight")), grouped, "left")


def bm25(rows: DataFrame, query: str, id_column: str = "chunk_id", text_column: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., id, lexical_raw): Okapi BM25 of every row, also those that match nothing.

    Document counts, lengths and the mean idf are those of the given rows, for each value of `by`. Repeated query terms
    count again. The texts are tokenised twice: for the vocabulary, whose groups also carry the rows' number and lengths,
    and for the scores.
    """
    words = Counter(_query_tokens(query))
    by = tuple(by)
    grouped = list(by) if by else ["_all"]
    base = rows if by else rows.withColumn("_all", F.lit(0))
    base = spread(base.select(*grouped, id_column, text_column))
    bags = base.select(*grouped, id_column, text.tokens(F.coalesce(text_column, F.lit(""))).alias("_t")).withColumn("dl", F.size("_t"))
    terms = bags.select(*grouped, "dl", F.explode(F.concat(F.array_distinct("_t"), F.array(F.lit(_ROWS)))).alias("term"))
    counted = terms.groupBy(*grouped, "term").agg(F.count("*").alias("df"), F.sum("dl").alias("total"))
    corpus = counted.where(F.col("term") == _ROWS).select(*grouped, F.col("df").alias("n"), (F.col("total") / F.col("df")).alias("avgdl"))
    table = _idf_table(counted.where(F.col("term") != _ROWS).select(*grouped, "term", "df"), corpus, words, grouped)
    # One pass over a bag keeps the few tokens the query asks for; the terms are counted among those.
    asked = F.filter("_t", lambda t: t.isin(list(words) or [""]))
    scored = bags.withColumn("_t", asked).join(F.broadcast(table), grouped)
    score = F.aggregate(F.array_sort(F.array_distinct("_t")), F.lit(0.0), lambda s, t: s + _part(F.col("weight")[t], F.size(F.filter("_t", lambda x: x == t))))
    return scored.select(*by, id_column, score.alias("lexical_raw"))


def _part(weight: Column, tf: Column) -> Column:
    """A term's share of the score; in groups without any token nothing has one."""
    return F.coalesce(weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))), F.lit(0.0))


def bm25_stored(bags: DataFrame, sizes: DataFrame, query: str, id_column: str = "chunk_id", by: tuple[str, ...] = ("scope",), vocabulary: DataFrame | None = None) -> DataFrame:
    """As `bm25`, from stored postings and lengths: no text is read, and of the postings' rows only the query's terms reach the scores.

    `vocabulary` (by..., term, df) spares the count over all postings; it must be that of the same rows.
    """
    words = Counter(_query_tokens(query))
    grouped = list(by)
    corpus = sizes.groupBy(*grouped).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    known = bags.groupBy(*grouped, "term").agg(F.count("*").alias("df")) if vocabulary is None else vocabulary
    table = F.broadcast(_idf_table(known, corpus, words, grouped))
    hits = bags.where(F.col("term").isin(list(words) or [""])).join(table, grouped)
    found = hits.groupBy(*grouped, id_column).agg(F.sum(_part(F.col("weight")[F.col("term")], F.col("tf"))).alias("lexical_raw"))
    return sizes.join(found, [*grouped, id_column], "left").select(*by, id_column, F.coalesce("lexical_raw", F.lit(0.0)).alias("lexical_raw"))


def _query_tokens(query: str) -> list[str]:
    import re

    return [t.lower() for t in re.findall(text.TOKEN, query or "")]


def normalise(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """lexical_score: the raw score over the greatest of its group; 0 where that is not positive.

    The scores pass one exchange on all their other columns, which the maximum and the rows both read: what made them runs once.
    """
    held = scored.repartition(*[c for c in scored.columns if c != "lexical_raw"])
    most = held.groupBy(*by).agg(F.max("lexical_raw").alias("_top"))
    joined = held.join(F.broadcast(most), list(by)) if by else held.join(F.broadcast(most), how="left")
    return joined.withColumn("lexical_score", F.when(F.col("_top") > 0, F.col("lexical_raw") / F.col("_top")).otherwise(0.0)).drop("_top")


def best_by_id(found: DataFrame, score: str = "dense_score", id_columns: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """The row of the highest score for each id; null scores come last."""
    best = Window.partitionBy(*id_columns).orderBy(F.desc_nulls_last(score))
    return found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == 1).drop("_r")


def fused_score(dense: Column, lexical: Column, dense_weight: float = 0.7, lexical_weight: float = 0.3) -> Column:
    """A missing side counts 0."""
    return dense_weight * F.coalesce(dense, F.lit(0.0)) + lexical_weight * F.coalesce(lexical, F.lit(0.0))


def fuse(dense: DataFrame, lexical: DataFrame, id_column: str = "chunk_id", dense_weight: float = 0.7, lexical_weight: float = 0.3) -> DataFrame:
    """Full outer join on the id; a missing side counts 0."""
    joined = dense.select(id_column, "dense_score").join(lexical.select(id_column, "lexical_score"), id_column, "full")
    score = fused_score(F.col("dense_score"), F.col("lexical_score"), dense_weight, lexical_weight)
    return joined.select(id_column, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("dense_score", "lexical_score")], score.alias("score"))


def hybrid_search(rows: DataFrame, query: str, query_vector: list[float], top_k: int = 10, scopes: tuple[str, ...] = ("code", "docs"), keep: Column | None = None, settings=None, lexical: DataFrame | None = None) -> DataFrame:
    """Dense shortlist and BM25 over all filtered rows of each scope, fused; chunk_id, dense_score, lexical_score, score.

    Rows without a matching term still fill the list. A query without tokens is dense only. `lexical` (scope, chunk_id,
    lexical_raw) are scores of the same rows from stored postings; without them the texts are read.
    """
    from corpusloom.config import Settings

    s = settings or Settings()
    keep = F.lit(True) if keep is None else keep
    dense = dense_search(rows, query_vector, max(top_k * s.hybrid_overfetch, s.hybrid_floor), scopes, keep, s.overfetch, s.overfetch_floor)
    if not _query_tokens(query):
        return dense.select("chunk_id", "dense_score", F.lit(None).cast("double").alias("lexical_score"), F.col("dense_score").alias("score")).orderBy(F.desc("score"), "chunk_id").limit(top_k)
    if lexical is None:
        lexical = bm25(rows.where(F.col("scope").isin(list(scopes)) & keep), query, by=("scope",))
    return fuse(dense, normalise(lexical, by=("scope",)), dense_weight=s.dense_weight, lexical_weight=s.lexical_weight).orderBy(F.desc("score"), "chunk_id").limit(top_k)


def result_rows(ranked: DataFrame, chunks: DataFrame, snippet_chars: int = 280) -> DataFrame:
    """Ranked ids with the compact columns of their chunks; the handful of ids is the small side of the join."""
    from corpusloom.schemas import RESULT_COLUMNS

    shown = chunks.withColumn("snippet", text.snippet(F.col("text"), snippet_chars)).drop("dense_score", "lexical_score", "score")
    return shown.join(F.broadcast(ranked), "chunk_id").select(*RESULT_COLUMNS).orderBy(F.desc("score"), "chunk_id")
