"""Splitting oversized chunks at natural boundaries (problem 3), by recursive bisection.

A text over the limit is cut at the strongest boundary near its midpoint, halves still over `limit - overlap`
are cut again, and finally every piece but the first is given the `overlap` characters before it. Pieces
without their overlap concatenate back to the text exactly.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_LIMIT

# Strength of a cut, strongest first. A cut stands at the end of the match, so that separators stay before it.
_BOUNDARIES: list[tuple[int, re.Pattern]] = [
    (6, re.compile(r"\n(?=#{1,6} |(?:async def|def|class)\b|\[\[?[\w.\-]+\]\]?\s*\n|---\s*\n)")),
    (5, re.compile(r"\n[ \t]*\r?\n(?=\S)")),
    (4, re.compile(r"\n[ \t]*\r?\n")),
    (3, re.compile(r"\n")),
    (2, re.compile(r"[.!?…;](?:[\"'»”)]*)\s+")),
    (1, re.compile(r"[\s,;|/]+")),
]
_PER_STRENGTH = 0.12  # a boundary one step weaker must lie this share of the length nearer to the midpoint


class _Text:
    def __init__(self, text: str):
        self.text = text
        self.cuts = [(strength, [m.end() for m in pattern.finditer(text)]) for strength, pattern in _BOUNDARIES]

    def cut(self, lo: int, hi: int) -> int:
        """The strongest boundary in the middle half of [lo, hi); without one, the midpoint."""
        mid, n = (lo + hi) // 2, hi - lo
        best, at = None, mid
        for strength, ends in self.cuts:
            i = bisect_left(ends, mid)
            for j in (i - 1, i):
                if 0 <= j < len(ends) and lo + n // 4 <= ends[j] <= hi - n // 4 and lo < ends[j] < hi:
                    score = strength * _PER_STRENGTH - abs(ends[j] - mid) / n
                    if best is None or score > best:
                        best, at = score, ends[j]
        if best is None and self.text[at - 1] == "\r" and self.text[at] == "\n" and at + 1 < hi:
            at += 1
        return at


def bisect_text(text: str, limit: int = CHUNK_LIMIT, overlap: int = 0) -> list[tuple[int, int, int]]:
    """(start, core start, end) offsets of the pieces in order; [start, core start) is the overlap.

    A text of at most `limit` characters is one piece. Needs 0 <= overlap < limit / 2.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be at least 0 and less than half the limit")
    if len(text) <= limit:
        return [(0, 0, len(text))]
    seen, todo, cores = _Text(text), [(0, len(text))], []
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= limit - overlap:
            cores.append((lo, hi))
        else:
            at = seen.cut(lo, hi)
            todo += [(at, hi), (lo, at)]
    return [(max(0, lo - overlap), lo, hi) for lo, hi in cores]


_PIECES = "chunk_id string, piece_no int, n_pieces int, text string, overlap_chars int, start_line int, end_line int, heading_path string, text_md5 string"


def _split_batches(limit: int, overlap: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for cid, text, line, heading, md5 in zip(batch["chunk_id"], batch["text"], batch["start_line"], batch["heading_path"], batch["text_md5"]):
                spans = bisect_text(text, limit, overlap)
                ends = [m.start() for m in re.finditer("\n", text)]
                first = None if pd.isna(line) else int(line)
                for n, (lo, core, hi) in enumerate(spans):
                    lines = (None, None) if first is None else (first + bisect_left(ends, lo), first + bisect_left(ends, hi - 1))
                    out.append((cid, n, len(spans), text[lo:hi], core - lo, *lines, heading, md5))
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in _PIECES.split(", ")])
            yield frame.astype({"start_line": "Int32", "end_line": "Int32"})

    return run


def split_oversized(chunks: DataFrame, limit: int = CHUNK_LIMIT, overlap: int = 80) -> DataFrame:
    """chunk_id, piece_no, n_pieces, text, overlap_chars, start_line, end_line, heading_path, text_md5 of oversized chunks.

    Only texts of more than `limit` code points are cut, so only they leave the JVM. Each piece has at most
    `limit` code points, overlap included. Lines are those the piece's characters stand on, counted from the
    chunk's start_line (null there gives null lines). A chunk_id repeated with the same text counts once; with
    different texts each text is split, since the data do not say which is right; text_md5 of the whole text tells them apart. Null texts are left out.
    """
    long = chunks.where(F.length("text") > limit).select("chunk_id", "text", "start_line", "heading_path")
    rows = long.groupBy("chunk_id", F.md5("text").alias("text_md5")).agg(F.min(F.struct("text", "start_line", "heading_path")).alias("_c")).select("chunk_id", "text_md5", "_c.*")
    return rows.mapInPandas(_split_batches(limit, overlap), _PIECES)
