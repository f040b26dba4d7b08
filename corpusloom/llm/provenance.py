"""Source files no person of the project wrote by hand (problem 4): generated, minified, vendored, or data.

1. Vendored copies. The hashes of the lines of all files form an inverted index. Lines that stand in few repositories are
   rare; a file's containment in another one is the exact share of its rare lines that stand there too. From
   `least_containment`, with `least_shared` lines, the other file holds a copy of it. What was copied from outside shows in
   the copies themselves, without any wording: the family (a file and those that hold it) spans three repositories or
   more, and two of them keep it in a folder of the same name, as packages are kept, while code handed around in the
   house lands under the names of its new places. A family of two counts if a member carries the marks of a third party (a
   licence head, or with the copies a vendor folder).
2. What has no copy here: a file's own marks, or a vendor folder with a package that is known from elsewhere. A folder
   name alone says nothing.
3. Token composition judges the remaining files: generator's notes, lock files, a machine's line shapes, minified lines,
   masses of literals.

Files of equal lines are one class, and the index holds classes. Within a repository files are compared with marked
ones only, so a third of all files in one repository costs no pairs among themselves. File bytes are never shuffled.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, known_time, latest, posix, spread
from .parsing import decode

_COMMENT = re.compile(r"^\s*(?:#|//|--|/\*|\*|<!--|;|%|\"\"\"|'''|REM\b)")
# Notes that generators leave, in the languages of the collection.
_GENERATED = re.compile(
    r"(?i)@generated\b|\bauto-?generated\b|<auto-?generated|\bcode generated\b|\b(?:machine|automatically|auto)[- ]?(?:written|generated|created|produced|built)\b"
    r"|\bgenerated (?:by|from|with|file|code|automatically)\b|\b(?:created|produced|written|emitted) by \w+gen\b|\bdo not (?:edit|modify)(?! \w+ \w+ by hand;)|\bchanges (?:will be|are) lost\b"
    r"|\bedit the (?:template|source|schema)\b|\bwird von \w+ (?:erzeugt|generiert)|\bautomatisch (?:erzeugt|generiert|erstellt)|\bnicht (?:von hand )?(?:bearbeiten|editieren)\b"
    r"|автоматически (?:создан|сгенерирован|сформирован)|сгенерирован\w* (?:утилит|автомат|из)|не (?:править|редактировать|изменять) вручную"
    r"|generado (?:autom|por|a partir)|creado autom|no (?:editar|modificar)(?: a mano)?\b"
)
_GENERATED_NAME = re.compile(r"(?i)(?:_pb2(?:_grpc)?|\.generated|_generated|_gen|\.gen|\.g|\.pb)\.\w+$")
_LOCK_NAME = re.compile(r"(?i)(?:^|/)(?:[\w.-]*lock|package-lock|resolved|npm-shrinkwrap)\.(?:json|toml|ya?ml)$|\.lock$|lock\.(?:json|toml|ya?ml)$")
_LOCK_LINE = re.compile(r"(?i)['\"]?(?:integrity|checksum|resolved)['\"]?\s*[:=]\s*['\"]?(?:sha\d+-)?[A-Za-z0-9+/=]{16,}")
_LOCK_ENTRY = re.compile(r"(?im)^\s*['\"]?version['\"]?\s*[:=]\s*['\"]?\d")
_MIN_NAME = re.compile(r"(?i)[.\-_]min\.\w+$")
_VENDOR_FOLDER = re.compile(r"(?i)(?:^|/)(?:_?vendor(?:ed|s)?|third[_-]?party|external|externals|extern|deps|node_modules|contrib|site-packages|bower_components)/")
_THIRD_PARTY = re.compile(
    r"(?i)\bpart of the \w+ (?:library|package|project|toolkit)\b|^\W*upstream\s*:|\bupstream release\b|\bsee LICEN[CS]E in the upstream"
    r"|\bcopyright (?:\(c\)|©|\d{4}).{0,40}\bauthors\b|^\W*(?:homepage|project url)\s*:\s*https?://|\bvendored from\b"
)
_NUMBER = re.compile(r"[+-]?\d[\d.,_]*(?:[eE][+-]?\d+)?")
_BLOB = re.compile(r"[A-Za-z0-9+/=_-]{40,}")
_STRING = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'")
_NAME = re.compile(r"[^\W\d]\w*")
_ESCAPES = re.compile(r"\\x[0-9a-fA-F]{2}")
CODE = ("py", "sql", "sh", "ps1", "js", "ts")


def leading_comments(text: str) -> list[str]:
    """The comment lines and module docstring before the first line of code."""
    out, quote = [], ""
    for line in text.split("\n"):
        bare = line.strip()
        if quote:
            out.append(line)
            quote = "" if quote in bare else quote
        elif _COMMENT.match(line):
            out.append(line)
            mark = bare[:3]
            if mark in ('"""', "'''") and mark not in bare[3:]:
                quote = mark
        elif bare:
            break
    return out


def line_shape(line: str) -> str:
    """A line with its literals and names replaced: what a template would leave alike."""
    return _NAME.sub("w", _NUMBER.sub("9", _STRING.sub("s", line.strip())))


def composition(text: str) -> dict[str, float]:
    """Shares of characters and lines that the rules read."""
    lines = [x for x in text.split("\n") if x.strip()]
    n, total = max(1, len(lines)), max(1, len(text))
    shapes: dict[str, int] = {}
    for x in lines:
        s = line_shape(x)
        shapes[s] = shapes.get(s, 0) + 1
    return {
        "chars": len(text),
        "lines": len(lines),
        "mean_line": sum(map(len, lines)) / n,
        "long_share": sum(len(x) for x in lines if len(x) > 300) / total,
        "space": sum(text.count(c) for c in " \t\r\n") / total,
        "digits": sum(map(text.count, "0123456789")) / total,
        "blob": sum(len(m) for m in _BLOB.findall(text) if not m.islower() and re.search(r"\d", m)) / total,
        "escapes": 4 * len(_ESCAPES.findall(text)) / total,
        # Named constants, one a line, are written by hand however alike they look.
        "top_shapes": sum(sorted((k for s, k in shapes.items() if s != "w = 9"), reverse=True)[:3]) / n,
        "shapes": len(shapes) / n,
    }


_CELL = re.compile(r'"source"\s*:\s*(\[(?:\s*"(?:\\.|[^"\\])*"\s*,?)*\s*\]|"(?:\\.|[^"\\])*")')


def notebook_source(text: str) -> str:
    """The text of a notebook's cells, also of a notebook that was cut off; any other text as it is."""
    if not text.lstrip().startswith("{") or '"cells"' not in text:
        return text
    out = []
    for m in _CELL.finditer(text):
        try:
            source = json.loads(m[1], strict=False)
        except ValueError:
            continue
        out.append(source if isinstance(source, str) else "".join(source))
    return "\n".join(out) or text


def is_prose(path: str) -> bool:
    return path.rsplit(".", 1)[-1].lower() in ("md", "rst", "txt")


def has_marks(path: str, text: str) -> bool:
    """Whether a source file's own leading comments name a third party."""
    return not is_prose(path) and any(_THIRD_PARTY.search(x) for x in leading_comments(text))


def in_vendor_folder(path: str) -> bool:
    return not is_prose(path) and bool(_VENDOR_FOLDER.search(path))


def judge(path: str, text: str) -> tuple[str | None, bool, dict[str, float]]:
    """(generated, minified, data or None; whether the file itself carries marks of a third party; composition)."""
    c = composition(text)
    return _kind(path, path.rsplit(".", 1)[-1].lower(), text, leading_comments(text), is_prose(path), c), has_marks(path, text), c


def _kind(path: str, suffix: str, text: str, head: list[str], prose: bool, c: dict[str, float]) -> str | None:
    if any(_GENERATED.search(x) for x in head) and not prose:
        return "generated"
    if prose:
        return None
    locks = len(_LOCK_LINE.findall(text))
    if locks >= 2 and len(_LOCK_ENTRY.findall(text)) >= 2 and (locks >= 0.08 * c["lines"] or _LOCK_NAME.search(path)):
        return "generated"
    if c["blob"] > 0.5 or (c["lines"] >= 4 and c["digits"] > 0.35) or c["escapes"] > 0.5:
        return "minified" if c["long_share"] > 0.5 and _MIN_NAME.search(path) else "data"
    if c["long_share"] > 0.5 and c["chars"] > 500 and (c["space"] < 0.08 or c["mean_line"] > 500):
        return "minified"
    if suffix in (*CODE, "json") and c["mean_line"] > 120 and c["chars"] > 500 and c["space"] < 0.05:
        return "minified"
    if suffix in (*CODE, "json") and c["lines"] >= 12 and c["top_shapes"] > 0.75 and c["digits"] > 0.12:
        return "data"
    if suffix in CODE and c["lines"] >= 6 and (c["escapes"] > 0.1 or (_GENERATED_NAME.search(path) and c["top_shapes"] > 0.5)):
        return "generated"
    if suffix in ("py", "js", "ts") and c["lines"] >= 10 and c["shapes"] < 0.3 and c["top_shapes"] > 0.6:
        return "generated"
    return None


def line_hashes(text: str) -> list[int]:
    """The distinct 64-bit hashes of the stripped lines that are not blank, in order."""
    return sorted({xxhash.xxh3_64_intdigest(x) - 2**63 for line in text.split("\n") if (x := line.strip())})


_READ = "repo_key string, relative_path string, mtime_ns bigint, kind string, marked boolean, foldered boolean, prose boolean, package string, class binary, lines array<bigint>"


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for repo, path, mtime, content in zip(batch["repo_key"], batch["relative_path"], batch["mtime_ns"], batch["content"]):
            text = decode(content)
            source = notebook_source(text)
            kind, marked, _ = judge(path, text)
            lines = line_hashes(source)
            name = xxhash.xxh3_128_digest(repr(lines))
            out.append((repo, path, int(mtime), kind, marked or has_marks(path, source), in_vendor_folder(path), is_prose(path), path.rpartition("/")[0].rpartition("/")[2], name, lines))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _READ.split(", ")])


def _copies(current: DataFrame, lines: DataFrame, most: int) -> DataFrame:
    """(a, b, shared, rare, across) of classes of which b holds rare lines of a: of different repositories (across), or b is marked.

    A class of several repositories differs from every other class's place, so it bears a label of its own; others bear that of
    their repository. Of a line's classes only those outside its commonest repository meet all others.
    """
    spans = current.groupBy("class").agg(F.min("repo").alias("home"), F.max("repo").alias("last"), F.max("marked").alias("marked"))
    holders = lines.groupBy("class", "repo").agg(F.first("lines").alias("lines")).join(spans, "class")
    label = F.when(F.col("home") == F.col("last"), F.col("home"))
    posting = holders.select("class", "repo", label.alias("own"), "marked", (F.col("repo") == F.col("home")).alias("once"), F.explode("lines").alias("line"))
    by_repo = posting.select("line", "repo", "own").groupBy("line", "repo").agg(F.count("*").alias("n"), F.count("own").alias("own"))
    by_line = by_repo.groupBy("line").agg(F.count("*").alias("repos"), F.sum("n").alias("n"), F.max_by("repo", F.struct("own", "repo")).alias("common")).where(F.col("n") > 1)
    # Lines that several classes or repositories hold, written once for the three ways to meet.
    told = cut(
        posting.where("once")
        .join(by_line, "line")
        .withColumn("label", F.coalesce("own", F.xxhash64("class")))
        .select("line", "class", "label", "marked", (F.col("label") == F.col("common")).alias("in_common"), (F.col("repos") > most).alias("boilerplate"))
    )
    boilerplate = told.where("boilerplate").groupBy("class").agg(F.count("*").alias("n"))
    size = current.groupBy("class").agg(F.max("size").alias("size"))
    rare = size.join(boilerplate, "class", "left").select(F.col("class").alias("a"), (F.col("size") - F.coalesce("n", F.lit(0))).alias("rare"))
    shared = told.where(~F.col("boilerplate")).drop("boilerplate")
    a, b = shared.toDF("line", "a", "la", "ma", "ca"), shared.toDF("line", "b", "lb", "mb", "cb")
    apart = (F.col("a") != F.col("b")) & (F.col("la") != F.col("lb"))
    met = [
        a.join(b.where(~F.col("cb")), "line").where(apart),
        a.where(~F.col("ca")).join(b.where("cb"), "line").where(apart),
        a.where(~F.col("ma")).join(b.where("mb"), "line").where((F.col("la") == F.col("lb")) & (F.col("a") != F.col("b"))),
    ]
    pairs = [x.select("a", "b", F.lit(n < 2).alias("across")) for n, x in enumerate(met)]  # no line meets twice
    counted = pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).groupBy("a", "b", "across").agg(F.count("*").alias("shared"))
    return counted.join(rare, "a").select("a", "b", "shared", "rare", "across")


def classify_files(files: DataFrame, rare_share: float = 0.25, least_rare: int = 8, least_containment: float = 0.5, least_shared: int = 5) -> DataFrame:
    """repo_key, relative_path (with `/`), kind, containment, evidence for the current version of every file.

    kind is generated, minified, data, vendored, or null for hand-written; a vendored file that is also one of
    the others keeps vendored. containment is the greatest share of a file's rare lines that stand in one file of another
    repository, or in a marked one of its own. A line is rare if at most `rare_share` of the repositories, or `least_rare`
    of them, hold it. evidence is copies (the family alone), marked_copy, mark, package or composition. The current version
    has the greatest mtime_ns (null is least, ties are equal rows). Null paths are left out, a null repo_key is a
    repository of its own, null content is an empty file.
    """
    rows = files.select("repo_key", posix("relative_path").alias("relative_path"), known_time(), "content").where(F.col("relative_path").isNotNull())
    read = spread(rows).mapInPandas(_read_batches, _READ)
    current = latest(read, ["repo_key", "relative_path"], ["mtime_ns"], [x.split()[0] for x in _READ.split(", ")][2:])
    current = cut(current.withColumn("repo", F.xxhash64(F.coalesce("repo_key", F.lit("\0")))).withColumnRenamed("class", "name"))
    numbers = cut(current.select("name").distinct().withColumn("class", F.monotonically_increasing_id()))  # of classes, numbered as they are written
    lines = current.select("name", "repo", "lines").join(numbers, "name").drop("name")
    current = cut(current.withColumn("size", F.size("lines")).drop("lines").join(numbers, "name").drop("name"))
    repositories = current.select("repo").distinct().count()
    copies = cut(_copies(current, lines, max(least_rare, math.ceil(rare_share * repositories))))
    share = F.col("shared") / F.col("rare")
    links = copies.where((share >= least_containment) & (F.col("shared") >= least_shared)).select("a", "b", "across")
    # The family of a class: itself and what holds it, by repository and folder.
    places = current.groupBy("class", "repo", "package").agg(F.max("marked").alias("marked"), F.max("foldered").alias("foldered"), F.max("prose").alias("prose"))
    itself = current.where(F.col("size") >= least_shared).select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(False).alias("across")).distinct()
    family = links.unionByName(itself).join(places.withColumnRenamed("class", "b"), "b")
    by_folder = family.groupBy("a", "package").agg(F.min("repo").alias("lo"), F.max("repo").alias("hi"), F.max("across").alias("across"), F.max("marked").alias("marked"), F.max("foldered").alias("foldered"), F.min("prose").alias("prose"))
    kept_alike = F.max((F.col("lo") < F.col("hi")) & (F.col("package") != "") & ~F.col("prose"))
    kin = by_folder.groupBy("a").agg(
        kept_alike.alias("alike"), F.max("marked").alias("marked_kin"), F.max("foldered").alias("foldered_kin"), (F.max("across") | (F.min("lo") < F.max("hi"))).alias("spread")
    )
    sizes = family.groupBy("a").agg(F.countDistinct("repo").alias("repos"))
    several = current.where(F.col("size") > 0).groupBy(F.col("class").alias("a")).agg(F.min("repo").alias("lo"), F.max("repo").alias("hi")).where(F.col("lo") < F.col("hi")).select("a", F.lit(1.0).alias("held"))
    best = copies.select("a", share.alias("held")).unionByName(several).groupBy("a").agg(F.max("held").alias("held"))
    of_class = cut(kin.join(sizes, "a").join(best, "a", "full").withColumnRenamed("a", "class"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    joined = current.join(of_class, "class", "left").withColumns(
        {
            "copies": yes(F.col("alike") & (F.col("repos") > 2) & ~F.col("prose")),
            "marked_copy": yes(~F.col("prose") & (F.col("marked_kin") | (F.col("spread") & F.col("foldered_kin"))) & ~F.col("marked")),
            "held": F.coalesce("held", F.lit(0.0)),
        }
    )
    # Packages known by a copy or a mark, with the repositories that hold them: one row a name.
    known = joined.where((F.col("copies") | F.col("marked_copy") | F.col("marked")) & (F.col("package") != "")).groupBy("package").agg(F.min("repo").alias("first_repo"), F.max("repo").alias("last_repo"))
    in_folder = joined.where("foldered").select("repo", "package").distinct().join(known, "package").where((F.col("repo") != F.col("first_repo")) | (F.col("repo") != F.col("last_repo")))
    found = joined.join(in_folder.select("repo", "package", F.lit(True).alias("known")), ["repo", "package"], "left")
    evidence = F.when(F.col("copies"), "copies").when(F.col("marked_copy"), "marked_copy").when(F.col("marked"), "mark").when(F.col("known") & F.col("foldered"), "package").when(F.col("kind").isNotNull(), "composition")
    kind = F.when(F.col("evidence") != "composition", "vendored").otherwise(F.col("kind"))
    return found.withColumn("evidence", evidence).select("repo_key", "relative_path", kind.alias("kind"), F.round("held", 4).alias("containment"), "evidence")
