"""Mixing sources to target weights (problem 8), by Poisson replication.

Every source has a rate: the mean number of times its tokens must appear for it to hold its target share of the
mixture. A document's count is read off the inverse distribution function of a Poisson law cut at the allowed
repeats, at a uniform number hashed from its id, so the count needs no coordination, no draw state and no sort,
and a lost task draws it again alike. Documents are exploded by their count and ordered by a hash: the global shuffle.

The mixture is as large as the scarcest source allows. Several hash seeds are summed in one pass and each source
takes the seed nearest its target, which removes most of the sampling noise of small sources.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spread

TOKENIZER = os.environ.get("CORPUSLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# The published splitting pattern of this vocabulary.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def _count_batches(path: str) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "n_tokens": [len(encoder.encode_ordinary(t)) for t in batch["text"]]})

    return run


def canonical_source(source: Column) -> Column:
    """Lower case, no padding, `-` and blanks as `_`; blank counts as null."""
    c = F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_")
    return F.when(c != "", c)


def count_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source (canonical), n_tokens. Null texts count as empty; rows without an id are left out."""
    rows = documents.select("doc_id", canonical_source(F.col("source")).alias("source"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("doc_id").isNotNull())
    return spread(rows).mapInPandas(_count_batches(tokenizer), "doc_id bigint, source string, n_tokens bigint")


def cut_poisson(rate: float, most: int) -> list[float]:
    """Distribution function at 0 .. most - 1 of a Poisson law cut at `most`, with this mean."""
    if rate >= most - 1e-9:
        return [0.0] * most
    if rate <= 0:
        return [1.0] * most

    def masses(lam: float) -> list[float]:
        logs = [j * math.log(lam) - math.lgamma(j + 1) for j in range(most + 1)]
        top = max(logs)
        m = [math.exp(x - top) for x in logs]
        return [x / sum(m) for x in m]

    lo, hi = 1e-12, 1.0
    mean = lambda lam: sum(j * p for j, p in enumerate(masses(lam)))
    while mean(hi) < rate and hi < 1e12:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean(mid) < rate else (lo, mid)
    out, total = [], 0.0
    for p in masses((lo + hi) / 2)[:-1]:
        total += p
        out.append(total)
    return out


def _uniform(seed: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64("doc_id", seed), 11) / F.lit(float(1 << 53))


def _count(seed: Column) -> Column:
    """How often a document is drawn: the thresholds its uniform number reaches."""
    u = _uniform(seed)
    return F.size(F.filter("thresholds", lambda t: t <= u))


def plan_mixture(counted: DataFrame, targets: DataFrame, budget: int | None = None, seeds: int = 48) -> list[dict]:
    """One row a source: share, repeats, tokens, rate, thresholds and seed. `targets` has one row a source, at most 10,000."""
    rows = targets.select(canonical_source(F.col("source")).alias("source"), "target_share", "max_repeats").where(F.col("source").isNotNull() & (F.col("target_share") > 0)).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("too many sources")
    whole = sum(r["target_share"] for r in rows)
    listed = counted.where(F.col("source").isin([r["source"] for r in rows]))
    have = {r["source"]: r["n"] for r in listed.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    wanted: dict[str, list] = {}
    for r in rows:  # spellings of one source add up
        old = wanted.setdefault(r["source"], [0.0, 1])
        wanted[r["source"]] = [old[0] + r["target_share"] / whole, max(old[1], r["max_repeats"] or 1)]
    plan = [{"source": name, "target_share": share, "max_repeats": most, "tokens": have.get(name) or 0} for name, (share, most) in sorted(wanted.items())]
    reach = [p["tokens"] * p["max_repeats"] / p["target_share"] for p in plan if p["tokens"]]
    size = min([*reach, *([budget] if budget else [])], default=0)
    for p in plan:
        p["rate"] = p["target_share"] * size / p["tokens"] if p["tokens"] else 0.0
        p["thresholds"] = cut_poisson(p["rate"], p["max_repeats"])
    if not plan:
        return plan
    sums = with_plan(counted, [{**p, "seed": 0} for p in plan])
    trial = [F.sum(_count(F.lit(s)) * F.col("n_tokens")).alias(f"s{s}") for s in range(seeds)]
    got = {r["source"]: r for r in sums.groupBy("source").agg(*trial).collect()}
    for p in plan:
        r = got.get(p["source"])
        p["seed"] = min(range(seeds), key=lambda s: (abs((r[f"s{s}"] or 0) - p["rate"] * p["tokens"]), s)) if r else 0
    return plan


def with_plan(rows: DataFrame, plan: list[dict]) -> DataFrame:
    """Rows of the planned sources with their thresholds and seed; a handful of sources is broadcast."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(p["source"], p["thresholds"], p["seed"]) for p in plan], "source string, thresholds array<double>, seed int")
    return rows.join(F.broadcast(table), "source")


def mixture(documents: DataFrame, plan: list[dict]) -> DataFrame:
    """doc_id, copy_no, source, text, shuffle_key in global random order: each document as often as drawn.

    The key is uniform, so equal ranges of it are equal partitions: no pass over the texts has to sample their bounds.
    """
    rows = documents.select("doc_id", canonical_source(F.col("source")).alias("source"), "text").where(F.col("doc_id").isNotNull())
    drawn = with_plan(rows, plan).withColumn("n", _count(F.col("seed"))).where(F.col("n") > 0)
    copies = drawn.select("doc_id", F.explode(F.sequence(F.lit(1), "n")).alias("copy_no"), "source", "text")
    keyed = copies.withColumn("shuffle_key", F.xxhash64("doc_id", "copy_no", F.lit("order")))
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.least(F.floor((F.col("shuffle_key") / F.lit(2.0**64) + 0.5) * n), F.lit(n - 1)).cast("int")
    return keyed.repartitionById(n, place).sortWithinPartitions("shuffle_key", "doc_id", "copy_no")


def report(counted: DataFrame, plan: list[dict]) -> DataFrame:
    """One row a planned source; see `mix_sources`. `counted` is read when the report is."""
    drawn = with_plan(counted, plan).withColumn("n", _count(F.col("seed"))).withColumn("first", _count(F.lit(0)))
    by = drawn.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("n")).alias("tokens_mixed"), F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("copies"), F.max("n").alias("max_copies"), F.sum(F.col("n_tokens") * F.col("first")).alias("first_tokens")
    )
    spark = counted.sparkSession
    listed = spark.createDataFrame([(p["source"], float(p["target_share"]), int(p["tokens"])) for p in plan], "source string, target_share double, tokens_available bigint")
    total = by.agg(F.sum("tokens_mixed").alias("_all"), F.sum("first_tokens").alias("_first"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    share = lambda c, whole: F.round(F.coalesce(c, F.lit(0)) / F.greatest(F.coalesce(whole, F.lit(0)), F.lit(1)), 6)
    return (
        listed.join(F.broadcast(by), "source", "left")
        .join(F.broadcast(total), how="left")
        .select(
            "source",
            "target_share",
            share("tokens_mixed", "_all").alias("actual_share"),
            share("first_tokens", "_first").alias("first_seed_share"),
            "tokens_available",
            *map(zero, ["tokens_mixed", "documents", "copies", "max_copies"]),
            F.round(F.coalesce("tokens_mixed", F.lit(0)) / F.greatest("tokens_available", F.lit(1)), 6).alias("mean_repeats"),
        )
    )


def mix_sources(documents: DataFrame, targets: DataFrame, budget: int | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    Report: source, target_share, actual_share, first_seed_share, tokens_available, tokens_mixed, documents, copies,
    max_copies, mean_repeats. actual_share is reached with the seeds chosen, first_seed_share is what the law gives with the
    first seed for all. The scarcest source is drawn max_repeats times throughout, as its rate is its cap. Documents of no or
    an unlisted source have no share and stay out. A source without documents is reported with nothing; the others keep their
    proportions. A repeated doc_id is drawn alike each time.
    """
    counted = cut(count_tokens(documents, tokenizer))
    plan = plan_mixture(counted, targets, budget)
    return mixture(documents, plan), report(counted, plan)
