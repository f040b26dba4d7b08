"""Source files that do not parse (problem 1).

Every file is decoded (UTF-8, invalid bytes dropped, a leading byte-order mark removed, CRLF taken as the line end it
is) and given to all grammars in the order of its token evidence, its own language first. What they accept decides: its
own grammar makes it valid; else a foreign grammar that accepts it, with evidence for that language, names a wrong
extension, and refusal by all of them means corruption. Grammars are the real ones: Python's own parser, JSON, TOML,
YAML 1.1 and bash. A worker without PyYAML or bash fails; no lesser check stands in.

Parsing is a map over the scan: file bytes are never shuffled. Only the verdict rows are, to keep the current
version of each path.
"""

from __future__ import annotations

import ast
import json
import re
import shutil
import subprocess
import tempfile
import tomllib
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import known_time, latest, posix, spread

try:
    import yaml

    _YAML_LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
except ImportError:
    yaml = None

SUFFIX_LANGUAGE = {"py": "python", "json": "json", "toml": "toml", "yml": "yaml", "yaml": "yaml", "sh": "bash"}
GRAMMARS = ("python", "json", "toml", "yaml", "bash")
SUFFIX_PATTERN = r"(?i)\.(py|json|toml|ya?ml|sh)$"

VERDICT_SCHEMA = (
    "repo_key string, relative_path string, mtime_ns bigint, language string, parses boolean, "
    "verdict string, parsed_as string, accepted array<string>, tried array<string>, message string"
)

# Token evidence for a language: (pattern, weight).
_EVIDENCE: dict[str, list[tuple[re.Pattern, float]]] = {
    "python": [(re.compile(r"(?m)^\s*(?:def|class|from|import|elif|with|return|raise)\b"), 2.0), (re.compile(r"(?m):\s*$"), 0.4), (re.compile(r"\bself\."), 1.0)],
    "json": [(re.compile(r'"[^"\n]*"\s*:'), 1.0), (re.compile(r"(?m)^\s*[}\]],?\s*$"), 0.6), (re.compile(r"\A\s*[{\[]"), 4.0)],
    "toml": [(re.compile(r"(?m)^\[\[?[\w.\-\"]+\]\]?\s*$"), 3.0), (re.compile(r"(?m)^[\w.\-]+ = "), 1.0)],
    "yaml": [(re.compile(r"(?m)^\s*[\w.\-]+:(?:\s|$)"), 1.0), (re.compile(r"(?m)^\s*- "), 0.5), (re.compile(r"(?m)^---\s*$"), 2.0)],
    "bash": [(re.compile(r"(?m)^\s*(?:if \[|fi\b|done\b|then\b|do\b|esac\b|export |local |echo )"), 2.0), (re.compile(r"\$\{?\w+"), 0.6), (re.compile(r"\A#!.*\bsh\b|\A#!.*bash"), 6.0)],
}


def decode(content: bytes | None) -> str:
    text = (content or b"").decode("utf-8", "ignore")
    return text[1:] if text.startswith("\ufeff") else text


def _python(text: str) -> None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
        except (RecursionError, MemoryError) as e:
            raise SyntaxError(f"too deeply nested: {type(e).__name__}") from None


def _json(text: str) -> None:
    try:
        json.loads(text)
    except RecursionError:
        raise ValueError("too deeply nested") from None


def _toml(text: str) -> None:
    try:
        tomllib.loads(text)
    except RecursionError:
        raise ValueError("too deeply nested") from None


MOST_DEPTH = 500


def _yaml(text: str) -> None:
    for _ in _yaml_events(text):
        pass


def _yaml_events(text: str) -> Iterator:
    """The events of all documents, with the composer's rules on anchors; an event stream needs no deep C stack."""
    if yaml is None:
        raise RuntimeError("this worker has no PyYAML")
    depth, anchors = 0, set()
    try:
        for event in yaml.parse(text, Loader=_YAML_LOADER):
            if isinstance(event, yaml.DocumentStartEvent):
                anchors = set()
            elif isinstance(event, yaml.AliasEvent):
                if event.anchor not in anchors:
                    raise ValueError(f"undefined alias {event.anchor}")
            elif isinstance(event, yaml.NodeEvent) and event.anchor is not None:
                if event.anchor in anchors:
                    raise ValueError(f"anchor {event.anchor} twice")
                anchors.add(event.anchor)
            depth += isinstance(event, yaml.CollectionStartEvent) - isinstance(event, yaml.CollectionEndEvent)
            if depth > MOST_DEPTH:
                raise ValueError("too deeply nested")
            yield event
    except (yaml.YAMLError, RecursionError) as e:
        raise ValueError(" ".join(str(e).split())) from None


_BASH = shutil.which("bash")
# Parses each text in a fork of its own: after `set -n` commands are read but none is run.
_BASH_MANY = """mapfile -d '' -t texts <"$1"
for t in "${texts[@]}"; do ( eval "set -n
$t" ) >/dev/null 2>&1 </dev/null; echo $?; done"""
BASH_BATCH = 128


def _run_bash(*given: str, text: bytes | None = None) -> subprocess.CompletedProcess:
    if _BASH is None:
        raise RuntimeError("this worker has no bash")
    return subprocess.run([_BASH, "--norc", *given], input=text, capture_output=True, env={"LC_ALL": "C", "PATH": ""})


def _bash(text: str) -> None:
    """`bash -n` reads without executing."""
    done = _run_bash("-n", text=text.encode("utf-8", "ignore"))
    if done.returncode:
        raise ValueError(done.stderr.decode("utf-8", "replace").strip()[:300])


def bash_accepts(texts: list[str]) -> list[bool]:
    """As `bash -n` of each text, many to a process. One with null bytes, and all of a process that ended early, are run by themselves."""

    def alone(text: str) -> bool:
        try:
            _bash(text)
            return True
        except ValueError:
            return False

    out: dict[int, bool] = {}
    together = [i for i, t in enumerate(texts) if "\0" not in t]
    for lo in range(0, len(together), BASH_BATCH):
        part = together[lo : lo + BASH_BATCH]
        with tempfile.NamedTemporaryFile() as f:
            f.write(b"".join(texts[i].encode("utf-8", "ignore") + b"\0" for i in part))
            f.flush()
            codes = _run_bash("-c", _BASH_MANY, "bash", f.name).stdout.split()
        if len(codes) == len(part):
            out.update(zip(part, (c == b"0" for c in codes)))
    return [out[i] if i in out else alone(t) for i, t in enumerate(texts)]


_PARSERS: dict[str, Callable[[str], None]] = {"python": _python, "json": _json, "toml": _toml, "yaml": _yaml, "bash": _bash}
_REFUSED = (SyntaxError, ValueError)


def rank_languages(text: str) -> list[tuple[str, float]]:
    """Grammars by token evidence per line, best first; ties keep the order of GRAMMARS."""
    lines = text.count("\n") + 1
    scored = [(name, round(sum(w * min(len(p.findall(text)), lines) for p, w in _EVIDENCE[name]) / lines, 4)) for name in GRAMMARS]
    return sorted(scored, key=lambda x: (-x[1], GRAMMARS.index(x[0])))


def _is_structured(name: str, text: str, score: float) -> bool:
    """YAML takes any prose as a scalar and bash nearly any words as commands: acceptance counts only with evidence."""
    if name == "yaml":
        return score > 0.2 and any(isinstance(e, yaml.CollectionStartEvent) for e in _yaml_events(text))
    return score > 0.2


def examine(text: str, language: str) -> tuple:
    """(parses, verdict, parsed_as, grammars that accept it, grammars tried, message of its own grammar).

    An empty or blank text parses except as JSON, as the grammars themselves hold. Foreign acceptances count with evidence only.
    """
    return examine_all([(text, language)])[0]


def examine_all(items: list[tuple[str, str]]) -> list[tuple]:
    in_bash = bash_accepts([text for text, _ in items])
    return [_verdict(text, language, bash) for (text, language), bash in zip(items, in_bash)]


def _verdict(text: str, language: str, bash: bool) -> tuple:
    ranked = rank_languages(text)
    order = [language, *(name for name, _ in ranked if name != language)]
    score, accepted, message = dict(ranked), [], None
    for name in order:
        try:
            if name != "bash":
                _PARSERS[name](text)
            elif not bash:
                if name == language:
                    _bash(text)  # for its message
                continue
            if name == language or _is_structured(name, text, score[name]):
                accepted.append(name)
        except _REFUSED as e:
            if name == language:
                message = (str(e) or type(e).__name__)[:300]
    first = accepted[0] if accepted else None
    return first == language, "valid" if first == language else "wrong_extension" if first else "corrupt", first, accepted, order, message


def _examine_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [decode(content).replace("\r\n", "\n") for content in batch["content"]]
        languages = [SUFFIX_LANGUAGE[path.rsplit(".", 1)[-1].lower()] for path in batch["relative_path"]]
        distinct = list(dict.fromkeys(zip(texts, languages)))  # repeated uploads of one version
        known = dict(zip(distinct, examine_all(distinct)))
        out = [(repo, path, int(mtime), language, *known[text, language]) for repo, path, mtime, text, language in zip(batch["repo_key"], batch["relative_path"], batch["mtime_ns"], texts, languages)]
        yield pd.DataFrame(out, columns=[x.split()[0] for x in VERDICT_SCHEMA.split(", ")])


def parse_files(files: DataFrame) -> DataFrame:
    """One row for the current version of each file with a supported suffix.

    In: repo_key, relative_path, content, mtime_ns; other columns are ignored. Out: repo_key, relative_path
    (with `/`), language, parses, verdict (valid, wrong_extension, corrupt), parsed_as, accepted, tried, message.
    The current version has the greatest mtime_ns (null counts as the least; equal times: a row that does
    not parse loses to one that does, so a repeated row changes nothing). Null paths are left out, a null
    repo_key is a group of its own, null content counts as an empty file. Empty input gives no rows.
    """
    rows = files.select("repo_key", posix("relative_path").alias("relative_path"), known_time(), "content").where(F.col("relative_path").rlike(SUFFIX_PATTERN))
    verdicts = spread(rows).mapInPandas(_examine_batches, VERDICT_SCHEMA)
    fields = ["mtime_ns", "parses", "language", "verdict", "parsed_as", "accepted", "tried", "message"]
    return latest(verdicts, ["repo_key", "relative_path"], ["mtime_ns", "parses"], fields).drop("mtime_ns")


def parse_rates(files: DataFrame) -> DataFrame:
    """Files, failures by kind and the failure rate for each repository and language."""
    bad = lambda kind: F.count(F.when(F.col("verdict") == kind, 1))
    return (
        parse_files(files)
        .groupBy("repo_key", "language")
        .agg(F.count("*").alias("n_files"), F.count(F.when(~F.col("parses"), 1)).alias("n_failed"), bad("wrong_extension").alias("n_wrong_extension"), bad("corrupt").alias("n_corrupt"))
        .withColumn("failure_rate", F.round(F.col("n_failed") / F.col("n_files"), 6))
    )
