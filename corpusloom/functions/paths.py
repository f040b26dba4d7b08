"""Expressions over relative paths: scope, tags, language and the choice of indexable files."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TEXT_SUFFIXES = [".py", ".md", ".txt", ".rst", ".yml", ".yaml", ".json", ".toml", ".ini", ".cfg", ".sh", ".ps1", ".sql"]
TEXT_NAMES = ["AGENTS.md", "CLAUDE.md", "README", "README.md", "Dockerfile"]
DOC_SUFFIXES = [".md", ".txt", ".rst"]
DOC_FOLDERS = ["docs/", "agent_context/"]
LANGUAGES = {
    ".py": "python", ".md": "markdown", ".yml": "yaml", ".yaml": "yaml", ".json": "json",
    ".toml": "toml", ".sh": "bash", ".ps1": "powershell", ".sql": "sql", ".txt": "text",
}
# (tag, substrings, prefixes) in the order of the result.
TAG_RULES = [
    ("telegram_bot", ["telegram-bot", "telegram_bot"], []),
    ("flow01", ["flow-01", "/user", "user-api"], []),
    ("maintenance", ["maintenance", "flow-02"], []),
    ("observability", ["observability"], []),
    ("docs", [], ["docs/"]),
    ("agent_context", [], ["agent_context/"]),
    ("load_reports", [], ["tools/testing/load/reports/"]),
]
NO_TAG = "general"


def posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def file_name(path: Column) -> Column:
    return F.substring_index(posix(path), "/", -1)


def suffix(path: Column) -> Column:
    """The last suffix with its dot, lower case; empty for `name`, `name.` and `.name`."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)\z", 1))


def scope(path: Column) -> Column:
    """`docs` by folder (case matters) or suffix, else `code`."""
    p = posix(path)
    in_docs = suffix(p).isin(DOC_SUFFIXES)
    for folder in DOC_FOLDERS:
        in_docs = in_docs | p.startswith(folder)
    return F.when(in_docs, "docs").otherwise("code")


def domain_tags(path: Column, rules: list[tuple[str, list[str], list[str]]] = TAG_RULES) -> Column:
    p = posix(path)
    hits = []
    for tag, inside, starts in rules:
        hit = F.lit(False)
        for s in inside:
            hit = hit | p.contains(s)
        for s in starts:
            hit = hit | p.startswith(s)
        hits.append(F.when(hit, F.lit(tag)))
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_TAG)))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(table[suffix(path)], F.lit("text"))


def glob_regex(glob: str) -> str:
    """A Java pattern for a shell glob in which `*` crosses `/`."""
    body = fnmatch.translate(glob)
    return "^" + re.sub(r"\\[Zz]\Z", r"\\z", body)


def matches_any(path: Column, globs: list[str]) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_regex(g))
    return hit


def is_confined(path: Column) -> Column:
    """Neither absolute nor leaving the tree by `..`."""
    p = posix(path)
    return ~(p.startswith("/") | p.rlike(r"^[A-Za-z]:") | p.rlike(r"(^|/)\.\.(/|\z)"))


def is_text_like(path: Column) -> Column:
    return suffix(path).isin(TEXT_SUFFIXES) | file_name(path).isin(TEXT_NAMES)


def should_index(path: Column, include: list[str], exclude: list[str]) -> Column:
    p = posix(path)
    return is_confined(p) & matches_any(p, include) & ~matches_any(p, exclude)
