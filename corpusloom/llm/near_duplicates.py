"""Near-duplicate texts (problem 5), by bottom-k sketches from one hash function.

1. Distinct texts become classes; exact copies are membership, never pairs. A class is known by 128 bits of its text and
   numbered when its table is written.
2. A class is the set of hashes of its shingles; its sketch is the k smallest.
3. Inverted lists of the retained values generate the overlaps. Similar sets share many of their retained values, so they
   also meet several times among their rarest ones: of each sketch only the values needed for that are listed, the rarest
   first. Values of boilerplate, with the longest lists, come last and are mostly left out; no list is cut. How rare a value
   is, is read off a table of `SLOTS` counters over all sketches: sharing a counter changes the order, which need
   only be the same for all, and so the cost, but no result.
4. The union of two sketches estimates their Jaccard similarity and drops clear misses.
5. The exact Jaccard similarity of the full sets decides.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

_TOKEN = re.compile(r"\w+")
SLOTS = 1 << 20
MEETINGS = 3  # listed values that similar sets share at least
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str) -> list[str]:
    """Maximal runs of Unicode letters, digits and underscores, lower-cased."""
    return _TOKEN.findall(text.lower())


def shingle_hashes(words: list[str], width: int, known: dict[str, int]) -> np.ndarray:
    """The distinct 64-bit hashes of all runs of `width` words, sorted as unsigned numbers."""
    if len(words) < width:
        return np.empty(0, dtype=np.uint64)
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(h) - width + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        mixed = (mixed * np.uint64(3) + h[i : i + n]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def pack(hashes: np.ndarray) -> bytes:
    """Six bytes a hash: two sets of a thousand shingles meet by chance once in 10^8 pairs."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    wide[:, 2:] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _shingle_batches(width: int, least_tokens: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            out = []
            for key, text in zip(batch["key"], batch["text"]):
                if len(known) > 200_000:
                    known.clear()
                words = tokens(text)
                if len(words) < least_tokens:
                    continue
                hashes = shingle_hashes(words, width, known)
                if len(hashes):
                    out.append((key, len(hashes), pack(hashes)))
            yield pd.DataFrame(out, columns=["key", "n", "shingles"])

    return run


def least_overlap(n: int, threshold: float, k: int) -> int:
    """Retained values that a set of n values shares with any set of at least the threshold's similarity.

    Up to threshold * k values the union of the two fits into k, so both sketches are complete and the count is certain.
    Of larger sets the k least values of the union are shared with the chance of their similarity; 4.2 deviations
    below its mean, a miss has a chance of about one in a hundred thousand at the threshold, and less above.
    """
    if n <= threshold * k:
        return max(1, math.ceil(threshold * n - 1e-9))
    return max(1, math.floor(threshold * k - 4.2 * math.sqrt(k * threshold * (1 - threshold))))


def listed(n: int, threshold: float, k: int) -> int:
    """How many values of a sketch, the rarest first, must be listed.

    Sets that share m values share c of them outside any m - c: with c = min(MEETINGS, m) similar sets meet c times.
    """
    m = least_overlap(n, threshold, k)
    return min(n, k) - m + min(MEETINGS, m)


def _sketch(shingles: bytes, k: int) -> np.ndarray:
    return (unpack(shingles[: 6 * k]) >> np.uint64(16)).astype(np.int64)


def _slot_batches(k: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for x in batch["shingles"]:
                n[_sketch(x, k) % SLOTS] += 1  # the values of a sketch are distinct; two in one slot count once
        at = np.flatnonzero(n)
        yield pd.DataFrame({"slot": at.astype(np.int32), "n": n[at]})

    return run


def value_counts(sets: DataFrame, k: int) -> np.ndarray:
    """How many sketches hold a value of each slot, at most 65,535: two bytes a slot, at any number of sketches."""
    rows = sets.select("shingles").mapInPandas(_slot_batches(k), "slot int, n bigint").groupBy("slot").agg(F.least(F.sum("n"), F.lit(65_535)).cast("int").alias("n")).toArrow()
    out = np.zeros(SLOTS, dtype=np.uint16)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def _list_batches(counts: np.ndarray, threshold: float, k: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan = [0, *(listed(n, threshold, k) for n in range(1, k + 2))]
        for batch in batches:
            values = []
            for x, n in zip(batch["shingles"], batch["n"]):
                v, most = _sketch(x, k), plan[min(n, k + 1)]
                values.append(v[np.lexsort((v, counts[v % SLOTS]))[:most]] if most < len(v) else v)
            sizes = [len(v) for v in values]
            each = lambda c: np.repeat(batch[c].to_numpy(), sizes)
            yield pd.DataFrame({"value": np.concatenate(values) if values else np.empty(0, dtype=np.int64), "class_id": each("class_id"), "n": each("n")})

    return run


def _short_batches(k: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            short = [np.frombuffer(x[: 6 * k], dtype=np.uint8).reshape(-1, 6)[:, 2:].tobytes() for x in batch["shingles"]]
            yield pd.DataFrame({"class_id": batch["class_id"], "short": short})

    return run


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, text) of the distinct texts, and (chunk_id, key) of the members. Null texts and ids are left out."""
    known = rows.select("chunk_id", "text").where(F.col("chunk_id").isNotNull() & F.col("text").isNotNull()).withColumn("key", F.unhex(F.md5("text")))
    return known.groupBy("key").agg(F.first("text").alias("text")), known.select("chunk_id", "key").distinct()


def candidates(sets: DataFrame, threshold: float, k: int) -> DataFrame:
    """(a, b, overlap) of classes whose listed values meet often enough; sizes that rule out the threshold do not."""
    posting = sets.select("class_id", "n", "shingles").mapInPandas(_list_batches(value_counts(sets, k), threshold, k), "value bigint, class_id bigint, n int")
    left, right = posting.toDF("value", "a", "na"), posting.toDF("value", "b", "nb")
    # Both sides are one exchange, read twice; a long list is split among tasks by the skew join.
    met = left.join(right, "value").where((F.col("a") < F.col("b")) & (F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9))
    small = min(n for n in range(1, k + 2) if least_overlap(n, threshold, k) >= MEETINGS)
    plan = F.array(*[F.lit(least_overlap(n, threshold, k)) for n in range(1, small)], F.lit(MEETINGS))
    least = F.element_at(plan, F.least("na", "nb", F.lit(small)))
    # Sizes are a class's own, so they only ride along.
    return met.groupBy("a", "b").agg(F.count("*").alias("overlap"), F.first(least).alias("least")).where(F.col("overlap") >= F.col("least")).select("a", "b", "overlap")


def _estimate(threshold: float, k: int) -> Callable:
    """Drop pairs whose union sketch holds too few shared values, four deviations below the threshold.

    The short sketches keep the upper four bytes of each value, in order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = np.frombuffer(x, dtype="<u4"), np.frombuffer(y, dtype="<u4")
                union = np.union1d(x, y)[:k]
                both = len(np.intersect1d(union, np.intersect1d(x, y)))
                keep.append(both / len(union) >= threshold - 4 * math.sqrt(threshold * (1 - threshold) / len(union)))
            yield batch.loc[keep, ["a", "b"]]

    return run


def _verify(threshold: float) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, b, x, y in zip(batch["a"], batch["b"], batch["x"], batch["y"]):
                x, y = unpack(x), unpack(y)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                jaccard = shared / (len(x) + len(y) - shared)
                if jaccard >= threshold - 1e-12:
                    out.append((a, b, jaccard))
            yield pd.DataFrame(out, columns=["a", "b", "jaccard"])

    return run


def similar_classes(rows: DataFrame, threshold: float = 0.8, width: int = 5, least_tokens: int = 0, k: int = 256, estimate_k: int = 48) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, b, jaccard) of distinct texts with a < b; (chunk_id, key); (class_id, key) of the texts that count.

    Texts with fewer than `least_tokens` tokens, or fewer than `width`, have no class number and link to none.
    Needs a threshold of at least 0.5. With k = 256 the sketches of most texts are complete: they list some 30 % of their
    values, where a cut one lists 43 %. The least `estimate_k` values of a sketch, a sketch themselves, serve the estimate.
    """
    if not 0.5 <= threshold <= 1:
        raise ValueError("the lists need a threshold of at least 0.5")
    texts, members = classes(rows)
    made = texts.mapInPandas(_shingle_batches(width, least_tokens), "key binary, n int, shingles binary")
    sets = cut(made.withColumn("class_id", F.monotonically_increasing_id()))  # numbered once, as the table is written
    pairs = candidates(sets, threshold, k).select("a", "b")
    short = sets.select("class_id", "shingles").mapInPandas(_short_batches(estimate_k), "class_id bigint, short binary")
    full = sets.select("class_id", "shingles")
    near = pairs.join(short.toDF("a", "x"), "a").join(short.toDF("b", "y"), "b").mapInPandas(_estimate(threshold, estimate_k), "a bigint, b bigint")
    links = near.join(full.toDF("a", "x"), "a").join(full.toDF("b", "y"), "b").mapInPandas(_verify(threshold), "a bigint, b bigint, jaccard double")
    return links, members, sets.select("class_id", "key")


def near_duplicate_groups(rows: DataFrame, threshold: float = 0.8, width: int = 5, least_tokens: int = 0) -> DataFrame:
    """chunk_id, class_id, copies, links, group_id: one row per chunk.

    class_id is the text's MD5, `copies` counts the chunks with exactly this text, `links` the other texts within
    the threshold, and group_id is one class of the connected component. A repeated chunk_id with the same text is one row.
    """
    links, members, numbers = similar_classes(rows, threshold, width, least_tokens)
    links, members = cut(links), cut(members)
    both = links.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("w")))
    degree = both.groupBy("v").agg(F.count("*").alias("links"))
    named = numbers.select(F.col("class_id").alias("group_id"), F.col("key").alias("group_key"))
    linked = numbers.join(degree.withColumnRenamed("v", "class_id"), "class_id").join(components(links), "class_id").join(named, "group_id").select("key", "links", "group_key")
    return (
        members.groupBy("key")
        .agg(F.count("*").alias("copies"))
        .join(linked, "key", "left")
        .join(members, "key")
        .select("chunk_id", F.lower(F.hex("key")).alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"), F.lower(F.hex(F.coalesce("group_key", "key"))).alias("group_id"))
    )


def components(links: DataFrame) -> DataFrame:
    """class_id, group_id of linked classes: alternating large-star and small-star steps until nothing changes."""
    edges = cut(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w")).where(F.col("v") != F.col("w")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("w").alias("v"), F.col("v").alias("w")))
        low = both.groupBy("v").agg(F.min("w").alias("m")).withColumn("m", F.least("m", "v"))
        large = both.join(low, "v").where(F.col("w") > F.col("v")).select(F.col("w").alias("v"), F.col("m").alias("w")).where(F.col("v") != F.col("w")).distinct()
        down = large.select(F.greatest("v", "w").alias("v"), F.least("v", "w").alias("w"))
        least = down.groupBy("v").agg(F.min("w").alias("m"))
        small = down.join(least, "v").select(F.col("w").alias("v"), F.col("m").alias("w")).unionByName(least.select("v", F.col("m").alias("w"))).where(F.col("v") != F.col("w")).distinct()
        after = cut(small)
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            break
        edges = after
    grouped = edges.groupBy(F.col("v").alias("class_id")).agg(F.min("w").alias("group_id"))
    return grouped.unionByName(grouped.select(F.col("group_id").alias("class_id"), "group_id").distinct()).groupBy("class_id").agg(F.min("group_id").alias("group_id"))


def near_duplicate_pairs(rows: DataFrame, threshold: float = 0.7, width: int = 3, least_tokens: int = 30, expand: int = 64) -> DataFrame:
    """chunk_id_a < chunk_id_b of similar chunks.

    Classes of at most `expand` copies give all their pairs. A larger class gives the pairs of its members with
    its first member, which together name the same group without a quadratic result; its links to other
    texts are given for its first member.
    """
    links, members, numbers = similar_classes(rows, threshold, width, least_tokens)
    members = cut(members.join(numbers, "key").select("chunk_id", "class_id"))
    sizes = members.groupBy("class_id").agg(F.count("*").alias("copies"), F.min("chunk_id").alias("first_id"))
    sized = members.join(sizes, "class_id")
    ends = sized.where((F.col("copies") <= expand) | (F.col("chunk_id") == F.col("first_id"))).select("class_id", "chunk_id")
    across = links.select("a", "b").join(ends.toDF("a", "p"), "a").join(ends.toDF("b", "q"), "b").select("p", "q")
    small = sized.where((F.col("copies") > 1) & (F.col("copies") <= expand)).select("class_id", "chunk_id")
    inside = small.toDF("c", "p").join(small.toDF("c", "q"), "c").where(F.col("p") < F.col("q")).select("p", "q")
    star = sized.where((F.col("copies") > expand) & (F.col("chunk_id") != F.col("first_id"))).select(F.col("first_id").alias("p"), F.col("chunk_id").alias("q"))
    pairs = across.unionByName(inside).unionByName(star)
    return pairs.select(F.least("p", "q").alias("chunk_id_a"), F.greatest("p", "q").alias("chunk_id_b")).where(F.col("chunk_id_a") != F.col("chunk_id_b")).distinct()
