"""Evaluation passages in training documents (problem 7), by spaced-seed hashing.

A seed is a fixed mask over `SPAN` consecutive words; the words at its open positions do not enter the hash, so
a window still meets its source when words there were replaced. Windows of the test passages and of the
documents are hashed under every mask and joined. Around each hit the two texts are laid side by side on the
diagonal of the hit: the longest exact run and the best overlap tolerating substitutions are measured there.

The test set is taken in blocks of at most `most_windows` windows. A block travels to the documents as sorted arrays, and the
join, the alignment and the verdict are one map over the documents: nothing of the corpus is shuffled but the leaks, and
a window that is common among the documents makes no group. A larger test set takes more passes over the corpus, each alike.
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

from .common import spread

SPAN = 13
# Fixed masks, chosen so that two substitutions in a window leave at least one of them untouched in most places.
MASKS = ("1101100110111", "1110011101101", "1011111001011", "1101011011101")
_WORD = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Maximal runs of Unicode letters and digits, lower-cased; underscores separate."""
    return _WORD.findall(text.lower())


def word_hashes(text: str, known: dict[str, int]) -> np.ndarray:
    found = words(text)
    for w in found:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))


def seed_hashes(hashes: np.ndarray, mask: int) -> np.ndarray:
    """One hash for each window of SPAN words under a mask."""
    n = len(hashes) - SPAN + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, mask + 1, dtype=np.uint64)
    for i, bit in enumerate(MASKS[mask]):
        if bit == "1":
            out = (out ^ hashes[i : i + n]) * _ODD
            out ^= out >> np.uint64(31)
    return out


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(longest exact run, words matched, words replaced) of the best stretch on a diagonal (document - item position).

    The stretch maximises matches minus twice the substitutions.
    """
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    same = doc[lo + diagonal : hi + diagonal] == item[lo:hi]
    edges = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
    run = int((edges[1::2] - edges[::2]).max()) if len(edges) else 0
    best = score = matched = start = stop = begin = 0
    for i, s in enumerate(same.tolist()):
        score += 1 if s else -2
        if score <= 0:
            score, begin = 0, i + 1
        elif score > best:
            best, start, stop = score, begin, i + 1
    matched = int(same[start:stop].sum())
    return run, matched, stop - start - matched


class _Tests:
    """The test passages as arrays: word hashes by item and all seed hashes, sorted."""

    def __init__(self, items: list[tuple[int, str]]):
        known: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        self.words = [word_hashes(t, known) for _, t in items]
        hashes, owner, place = [], [], []
        for n, w in enumerate(self.words):
            for m in range(len(MASKS)):
                h = seed_hashes(w, m)
                hashes.append(h)
                owner.append(np.full(len(h), n))
                place.append(np.arange(len(h)))
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
        order = self.hashes.argsort(kind="stable")
        self.hashes = self.hashes[order]
        self.owner = np.concatenate(owner)[order] if owner else order
        self.place = np.concatenate(place)[order] if place else order
        # A first look by the high 20 bits keeps the search off the windows that match nothing.
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def diagonals(self, doc: np.ndarray) -> set[tuple[int, int]]:
        out: set[tuple[int, int]] = set()
        for m in range(len(MASKS)):
            h = seed_hashes(doc, m)
            at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
            for p, a, b in zip(at[lo < hi], lo[lo < hi], hi[lo < hi]):
                out.update((int(o), int(p - q)) for o, q in zip(self.owner[a:b], self.place[a:b]))
        return out


_FOUND = "doc_id bigint, item_id bigint, longest_run int, matched_words int, replaced_words int, item_words int"
_COLUMNS = ["doc_id", "item_id", "longest_run", "matched_words", "replaced_words", "item_words"]


def _search(items: list[tuple[int, str]]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tests, known = _Tests(items), {}
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                if len(known) > 200_000:
                    known.clear()
                doc = word_hashes(text, known)
                best: dict[int, tuple[int, int, int]] = {}
                for n, diagonal in tests.diagonals(doc):
                    got = overlap(doc, tests.words[n], diagonal)
                    old = best.get(n, (0, 0, 0))
                    best[n] = (max(got[0], old[0]), *max(got[1:], old[1:], key=lambda x: (x[0] - 2 * x[1], x)))
                out += [(doc_id, tests.ids[n], *b, len(tests.words[n])) for n, b in best.items()]
            yield pd.DataFrame(out, columns=_COLUMNS)

    return run


def _blocks(tests: DataFrame, most_windows: int) -> Iterator[list[tuple[int, str]]]:
    """The test passages in blocks: by a hash of the item, so many that each holds at most about `most_windows` windows."""
    # A word takes at least two characters with its separator, so this bounds the windows.
    size = tests.agg(F.sum(F.length("passage")).alias("chars"), F.count("*").alias("items")).first()
    windows = (size["chars"] or 0) / 2 * len(MASKS)
    n = max(1, min(size["items"], math.ceil(windows / max(1, most_windows))))  # a passage stays whole
    for block in range(n):
        part = tests.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(n)) == block) if n > 1 else tests
        yield sorted((r["item_id"], r["passage"]) for r in part.collect())


def find_leaks(documents: DataFrame, items: DataFrame, least_run: int = SPAN, least_matched: int = 2 * SPAN, most_windows: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, longest_run, matched_words, replaced_words, item_words, exact of each leak.

    A pair is a leak if at least `least_run` consecutive words agree (exact), or the overlap with substitutions
    has at least `least_matched` agreeing words. `least_run` may not be less than SPAN. Passages of fewer words
    than SPAN cannot be found. Rows with a null id or text are left out; a repeated row counts once; no items
    or no documents give no rows.
    """
    if least_run < SPAN:
        raise ValueError(f"least_run must be at least {SPAN}")
    docs = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    tests = items.select("item_id", "passage").where(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).distinct()
    docs, found = spread(docs), None
    for block in _blocks(tests, most_windows):
        part = docs.mapInPandas(_search(block), _FOUND)
        found = part if found is None else found.unionByName(part)
    score = F.col("matched_words") - 2 * F.col("replaced_words")
    one = found.groupBy("doc_id", "item_id").agg(F.max("longest_run").alias("longest_run"), F.max_by(F.struct("matched_words", "replaced_words"), F.struct(score, "matched_words")).alias("o"), F.max("item_words").alias("item_words"))
    named = one.select("doc_id", "item_id", "longest_run", "o.matched_words", "o.replaced_words", "item_words", (F.col("longest_run") >= least_run).alias("exact"))
    return named.where(F.col("exact") | (F.col("matched_words") >= least_matched))
