"""Files to chunks: one Python pass finds the spans, the JVM adds identity, scope, language and tags.

Only what needs a parser or a sequential scan runs in Python (the syntax tree, greedy windows, the heading
stack, oversized parts). Each file is handled in one call, so its text crosses to Python once.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import Settings
from corpusloom.functions import hashing, paths

_HEADING = re.compile(r"^(#{1,6})\s+(.*\S)\s*$")
_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
SUMMARY_LINES = 20
BACK_OFF = 5


class Span(NamedTuple):
    chunk_type: str
    locator: str
    text: str
    start_line: int
    end_line: int
    symbol_path: str | None = None
    heading_path: str | None = None


class Part(NamedTuple):
    number: int  # 0: the chunk was not split
    text: str
    start_line: int
    end_line: int


def read_text(content: bytes | None) -> str:
    """UTF-8 without invalid bytes, line ends as `\\n`; a byte-order mark stays."""
    return (content or b"").decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")


def windows(text: str, most_lines: int = 80, most_chars: int = 2400) -> Iterator[Span]:
    """Consecutive windows of lines. An overlong one gives back BACK_OFF lines at a time while more than that remain.

    Window numbers count blank windows too, which are not emitted.
    """
    lines = text.splitlines()
    n = len(lines)
    before = [0, *accumulate(len(x) + 1 for x in lines)]  # characters before each line
    full = [i for i, x in enumerate(lines) if x.strip()]

    def bounds(lo: int, hi: int) -> tuple[int, int]:
        """Where the text of the lines begins and ends without the blanks around it."""
        first, last = bisect_left(full, lo), bisect_left(full, hi) - 1
        if first > last:
            return 0, 0
        head, tail = lines[full[first]], lines[full[last]]
        return before[full[first]] + len(head) - len(head.lstrip()), before[full[last]] + len(tail.rstrip())

    whole, at, number = "\n".join(lines), 0, 0
    while at < n:
        number += 1
        stops = range(min(at + most_lines, n), at, -BACK_OFF)  # the last one leaves BACK_OFF lines or fewer
        ends = ((stop, *bounds(at, stop)) for stop in stops)
        stop, lo, hi = next((e for e in ends if e[2] - e[1] <= most_chars), (stops[-1], *bounds(at, stops[-1])))
        if lo < hi:
            yield Span("generic_window", f"generic:{number}:{at + 1}:{stop}", whole[lo:hi], at + 1, stop)
        at = stop


def section_parts(text: str, most_chars: int = 2600) -> list[str]:
    """A section over the limit is cut at each first blank line after `most_chars` characters."""
    if len(text) <= most_chars:
        return [text]
    parts, held, size = [], [], 0
    for line in text.splitlines():
        held.append(line)
        size += len(line) + 1
        if size >= most_chars and not line.strip():
            parts.append(held)
            held, size = [], 0
    return [p for p in ("\n".join(x).strip() for x in [*parts, held]) if p]


def headings(lines: list[str]) -> list[tuple[int, int, str]]:
    """(line number, level, path of the ancestors and itself) of every heading."""
    out, ancestors = [], []
    for n, line in enumerate(lines, 1):
        if m := _HEADING.match(line):
            level = len(m[1])
            ancestors = [a for a in ancestors if a[0] < level] + [(level, m[2].strip())]
            out.append((n, level, " / ".join(title for _, title in ancestors)))
    return out


def sections(text: str, section_chars: int = 2600, **window: int) -> Iterator[Span]:
    """One span a heading down to the next heading, under the path of its ancestors; text before the first is not covered."""
    lines = text.splitlines()
    marks = headings(lines)
    if not marks:
        yield from windows(text, **window)
        return
    stops = [n - 1 for n, _, _ in marks[1:]] + [len(lines)]
    for (start, _, path), stop in zip(marks, stops):
        for k, part in enumerate(section_parts("\n".join(lines[start - 1 : stop]).strip(), section_chars), 1):
            yield Span("markdown_section", f"{path}:{k}:{start}:{stop}", part, start, stop, heading_path=path)


def definitions(text: str, **window: int) -> Iterator[Span]:
    """Python: the preamble, functions, class heads and methods. Decorators and what follows the first definition otherwise are not covered."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        yield from windows(text, **window)
        return
    lines = text.splitlines()

    def source(first: int, last: int) -> str:
        return "\n".join(lines[first - 1 : last]).strip()

    def span(kind: str, label: str, first: int, last: int, name: str) -> Iterator[Span]:
        if code := source(first, last):
            yield Span(kind, f"{label}:{name}:{first}:{last}", code, first, last, name)

    def class_head(node: ast.ClassDef) -> Span:
        """The lines before the first statement of the body, SUMMARY_LINES after the first at most; the class line itself always."""
        own, ends = node.lineno, min(node.end_lineno, node.lineno + SUMMARY_LINES)
        ends = min(ends, node.body[0].lineno - 1)
        return Span("class_summary", f"class:{node.name}:summary:{own}:{ends}", source(own, max(own, ends)), own, max(own, ends), node.name)

    tops = [n for n in body if isinstance(n, _DEFINITIONS)]
    found = 0
    if tops:
        before = tops[0].lineno - 1
        if head := source(1, before):
            found += 1
            yield Span("module_preamble", f"module_preamble:1:{before}", head, 1, before)
    for node in tops:
        if not isinstance(node, ast.ClassDef):
            kind = "python_async_function" if isinstance(node, ast.AsyncFunctionDef) else "python_function"
            for s in span(kind, "function", node.lineno, node.end_lineno, node.name):
                found += 1
                yield s
            continue
        if source(node.lineno, node.end_lineno):
            found += 1
            yield class_head(node)
            methods = (x for x in node.body if isinstance(x, _DEFINITIONS[:2]))
            yield from (s for x in methods for s in span("python_method", "method", x.lineno, x.end_lineno, f"{node.name}/{x.name}"))
    if not found:
        yield from windows(text, **window)


def spans(path: str, text: str, window_lines: int = 80, window_chars: int = 2400, section_chars: int = 2600) -> Iterator[Span]:
    """The spans of a file by its suffix; a blank text has none."""
    if not text.strip():
        return iter(())
    name = path.rsplit("/", 1)[-1]
    suffix = "." + name.rsplit(".", 1)[-1].lower() if "." in name.lstrip(".") else ""
    window = {"most_lines": window_lines, "most_chars": window_chars}
    if suffix == ".py":
        return definitions(text, **window)
    if suffix in paths.DOC_SUFFIXES or name.endswith(".md"):
        return sections(text, section_chars, **window)
    return windows(text, **window)


def parts(text: str, start_line: int, end_line: int, most: int = 800, legacy_lines: bool = False) -> list[Part]:
    """Greedy packing of whole lines up to `most` characters; a longer line is cut by itself.

    Lines are those the characters stand on. With `legacy_lines` a part that ends in a line break reports one
    line more than it has and its follower starts one further, as older indexes have it.
    """
    if len(text) <= most:
        return [Part(0, text, start_line, end_line)]
    packed: list[str] = []
    open_ = False
    for line in text.splitlines(keepends=True):
        if len(line) > most:
            packed += [line[i : i + most] for i in range(0, len(line), most)]
            open_ = False
        elif open_ and len(packed[-1]) + len(line) <= most:
            packed[-1] += line
        else:
            packed.append(line)
            open_ = True
    out, at = [], start_line
    for n, body in enumerate(packed, 1):
        breaks = body.count("\n")
        if legacy_lines:
            out.append(Part(n, body, at, at + breaks))
            at += breaks + body.endswith("\n")
        else:
            out.append(Part(n, body, at, at + breaks - body.endswith("\n")))
            at += breaks
    return out


_NO_TIME = -(2**63)  # a null among the times would turn a whole Python batch of them to floats
_SPANS = "relative_path string, mtime_ns bigint, chunk_type string, locator string, whole string, text string, part int, start_line int, end_line int, symbol_path string, heading_path string"


def _chunk_batches(settings: Settings, extra: tuple[str, ...]) -> Callable:
    sizes = {"window_lines": settings.window_lines, "window_chars": settings.window_chars, "section_chars": settings.section_chars}
    names = [*extra, *(x.split()[0] for x in _SPANS.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            keys = zip(*(batch[c] for c in extra)) if extra else iter(lambda: (), None)
            for key, path, mtime, content, split in zip(keys, batch["relative_path"], batch["mtime_ns"], batch["content"], batch["split"]):
                for s in spans(path, read_text(content), **sizes):
                    pieces = parts(s.text, s.start_line, s.end_line, settings.max_chunk_chars, settings.legacy_lines) if split else [Part(0, s.text, s.start_line, s.end_line)]
                    for p in pieces:
                        out.append((*key, path, int(mtime), s.chunk_type, s.locator, s.text if p.number else None, p.text, p.number, p.start_line, p.end_line, s.symbol_path, s.heading_path))
            yield pd.DataFrame(out, columns=names)

    return run


def chunk_files(files: DataFrame, settings: Settings = Settings(), keys: tuple[str, ...] = ()) -> DataFrame:
    """The chunk rows (schemas.CHUNK without embedding columns) of indexable files, oversized ones in parts.

    In: relative_path, content, mtime_ns, optional string `keys` carried along, optional boolean `split`
    (default true). Paths are normalised; files outside the globs, unconfined paths and blank files give none.
    """
    if "split" not in files.columns:
        files = files.withColumn("split", F.lit(True))
    path = paths.posix(F.col("relative_path"))
    chosen = files.select(*keys, path.alias("relative_path"), F.coalesce("mtime_ns", F.lit(_NO_TIME)).alias("mtime_ns"), "content", F.coalesce("split", F.lit(True)).alias("split")).where(F.col("relative_path").isNotNull() & paths.is_text_like(F.col("relative_path")) & paths.should_index(F.col("relative_path"), settings.include_globs, settings.excludes))
    kinds = "".join(f"{k} string, " for k in keys)
    found = chosen.mapInPandas(_chunk_batches(settings, keys), kinds + _SPANS)
    found = found.withColumn("mtime_ns", F.nullif("mtime_ns", F.lit(_NO_TIME)))
    whole = F.coalesce("whole", "text")
    base = hashing.point_id(F.col("relative_path"), F.col("locator"), whole)
    is_part = F.col("part") > 0
    p = F.col("relative_path")
    # Every Python chunk is Python and every section Markdown, whatever the suffix; windows go by the suffix.
    language = F.when(F.col("chunk_type") == "markdown_section", "markdown").when(F.col("chunk_type") != "generic_window", "python").otherwise(paths.language(p))
    extra = F.when(is_part, F.create_map(F.lit("locator"), F.col("locator"), F.lit("split_part"), F.col("part").cast("string"))).otherwise(F.create_map(F.lit("locator"), F.col("locator")))
    return found.select(
        *keys,
        F.when(is_part, F.concat(base, F.lit(":part"), F.col("part"))).otherwise(base).alias("chunk_id"),
        paths.scope(p).alias("scope"),
        "relative_path",
        language.alias("language"),
        F.when(is_part, F.concat("chunk_type", F.lit("_part"))).otherwise(F.col("chunk_type")).alias("chunk_type"),
        "text",
        "start_line",
        "end_line",
        hashing.content_hash(whole).alias("content_hash"),
        (F.col("mtime_ns") / F.lit(1e9)).alias("source_mtime"),
        "mtime_ns",
        "symbol_path",
        "heading_path",
        paths.domain_tags(p).alias("domain_tags"),
        F.lit(False).alias("is_generated"),
        extra.alias("extra"),
    )
