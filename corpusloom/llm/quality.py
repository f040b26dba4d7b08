"""Text statistics of every document, and natural prose told from the rest (problem 9).

A document is read once, in segments: comment prefixes shared by its lines are taken off and hard-wrapped lines are
joined; each paragraph of running text is a segment, and the lines that stand alone (items, rows, frames of a trace,
rules) form one segment of each kind. A segment yields two count vectors: over the function words of its language (in
bands of frequency, beside all other words), and over character classes, counted in runs, so that a word is one event
and a full stop weighs as much as a word. Both are compared with the prose profile of that language, the sum over all
documents' running text, by the Jensen-Shannon divergence. A segment is prose if both divergences are small, and nothing
else makes it prose: bullets, tabs and time stamps only say whether the rest is a list, a table or junk. The shares of a document's
characters in prose, list, table and junk segments give its place among the structural profiles; the nearest is assigned.

What is small is fitted on the labelled documents (at most `MOST_LABELS` rows); without labels fixed limits hold. The
structural profiles are the labelled documents' mean shares, or the pure forms. The counts are written once and all later
steps read them, never the texts again.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread

MOST_LABELS = 100_000
MOST_WORDS = 100_000
FORMS = ("prose", "list", "table", "junk")
KINDS = ("text", "item", "row", "trace", "rule")
CLASSES = ("lower", "upper", "digit", "space", "stop", "mark", "symbol", "other", "gap")
LOWER, UPPER, DIGIT, SPACE, STOP, MARK, SYMBOL, OTHER, GAP = range(len(CLASSES))
BANDS = 2  # of equal weight, into which a language's function words are put by frequency: single words are too rare in a short text
LONG_RUN = 32  # characters of a run that count as one
SMOOTHING = 10.0  # words or runs of the profile itself that a segment is taken to hold before its own
CHAR_LIMIT, WORD_LIMIT = 0.02, 0.6  # without labels
_STOPS, _MARKS, _CLOSERS = ".!?…", ",;:'’\"«»“”„()-–—¿¡", "\"'»”)]"
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_TERMINAL = re.compile(r"[.!?…:;][\"'»”)\]`*_]*\s*$")
_STOP = re.compile(r"[.!?…][\"'»”)\]]*(?=\s|$)")
_PREFIX = re.compile(r"^[ \t]*(?://+!?|#+!?|--+|;+|%+|>+|\"\"\"|'''|/\*+|\*/|REM\b)[ \t]?")
_BULLET = re.compile(r"^\s*(?:[-*+•·–—▪]\s+|\(?\d{1,4}[.)]\s+|[a-z][.)]\s+|\[[ xX]?\]\s+|- \[[ xX]\]\s+)")
_TABULAR = re.compile(r"\t|^\s*\||\S {2,}\S|^[^.!?]*[;,][^ ]*[;,]")
_TRACE = re.compile(r"^\s*(?:File \"|at [\w.$<>]+\(|\d{4}-\d\d-\d\d[T ]\d\d:|\[?\d\d:\d\d:\d\d|[A-Z][A-Za-z]*(?:Error|Exception)\b|(?:DEBUG|INFO|WARN|WARNING|ERROR|TRACE|FATAL)\b|Traceback )")


def comment_stripped(lines: list[str]) -> list[str]:
    """Lines without a comment prefix that most non-blank lines share; a list bullet alone is no such prefix."""
    full = [x for x in lines if x.strip()]
    marks = Counter(m[0].strip() for x in full if (m := _PREFIX.match(x)))
    if not marks:
        return lines
    mark, n = marks.most_common(1)[0]
    if n < 0.8 * len(full):
        return lines
    return [x[m.end() :] if (m := _PREFIX.match(x)) and m[0].strip() == mark else x for x in lines]


def blocks(text: str) -> list[tuple[str, str]]:
    """(kind, text) of the blocks: `text` for joined running lines, `item`, `row`, `trace` and `rule` for single lines."""
    out: list[tuple[str, str]] = []
    joined: list[str] = []

    def flush() -> None:
        if joined:
            out.append(("text", " ".join(joined)))
            joined.clear()

    for line in comment_stripped(text.splitlines()):
        bare = line.strip()
        if not bare:
            flush()
        elif not any(c.isalnum() for c in bare):
            flush()
            out.append(("rule", bare))
        elif _TRACE.match(line):
            flush()
            out.append(("trace", bare))
        elif _BULLET.match(line):
            flush()
            item = _BULLET.sub("", line).strip()
            out.append(("item", item))
        elif _TABULAR.search(line) and not _STOP.search(line):
            flush()
            out.append(("row", bare))
        elif " " not in bare and not _TERMINAL.search(bare):
            flush()
            out.append(("item", bare))
        else:
            joined.append(bare)
    flush()
    return out


def segments(text: str) -> list[tuple[int, str]]:
    """(place in KINDS, text): every paragraph by itself, the other blocks joined by kind. A few words without an end are an item: they head one."""
    out, pooled = [], {}
    for kind, block in blocks(text):
        if kind == "text" and len(block.split(None, 4)) < 5 and not _TERMINAL.search(block):
            kind = "item"
        if kind == "text":
            out.append((0, block))
        else:
            pooled.setdefault(KINDS.index(kind), []).append(block)
    return out + [(kind, "\n".join(pooled[kind])) for kind in sorted(pooled)]


SLICE = 1 << 20  # characters looked at in one go, so that memory follows the longest text and not the batch


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


def _class_of(c: str) -> int:
    if c in "\n\t":
        return GAP
    if c.isspace():
        return SPACE
    if c.isupper():
        return UPPER
    if c.isalpha():
        return LOWER
    if c.isdigit():
        return DIGIT
    return STOP if c in _STOPS else MARK if c in _MARKS else SYMBOL if ord(c) < 128 else OTHER


class _Characters:
    """The class of every character and whether it is a symbol (neither alphanumeric nor blank), by table."""

    BASIC = 0x10000

    def __init__(self):
        basic = [chr(i) for i in range(self.BASIC)]
        self.classes = np.array([_class_of(c) for c in basic], dtype=np.uint8)
        self.symbols = np.array([not c.isalnum() and not c.isspace() for c in basic])

    def codes(self, texts: list[str]) -> np.ndarray:
        return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")

    def _beyond(self, codes: np.ndarray, out: np.ndarray, rule: Callable) -> np.ndarray:
        for i in np.flatnonzero(codes >= self.BASIC):
            out[i] = rule(chr(codes[i]))
        return out

    def symbol_counts(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([self._symbol_counts(texts[a:b]) for a, b in _slices(texts)] or [np.zeros(0, dtype=np.int64)])

    def _symbol_counts(self, texts: list[str]) -> np.ndarray:
        codes = self.codes(texts)
        is_symbol = self._beyond(codes, self.symbols[np.minimum(codes, self.BASIC - 1)], lambda c: not c.isalnum() and not c.isspace())
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        return np.bincount(owner[is_symbol], minlength=len(texts))

    def runs(self, texts: list[str], kinds: np.ndarray) -> np.ndarray:
        """Runs of each class for each text. A stop counts where a sentence can end, else as a symbol; blanks of more
        than one character are a gap, but not in running text; in capitals the two cases change places."""
        return np.concatenate([self._runs(texts[a:b], kinds[a:b]) for a, b in _slices(texts)] or [np.zeros((0, len(CLASSES)), dtype=np.int64)])

    def _runs(self, texts: list[str], kinds: np.ndarray) -> np.ndarray:
        k, n = len(CLASSES), len(texts)
        codes = self.codes(texts)
        if not len(codes):
            return np.zeros((n, k), dtype=np.int64)
        cls = self._beyond(codes, self.classes[np.minimum(codes, self.BASIC - 1)], _class_of)
        owner = np.repeat(np.arange(n), [len(t) for t in texts])
        last = np.append(owner[1:] != owner[:-1], True)
        after = np.where(last, GAP, np.append(cls[1:], GAP))
        cls = np.where((cls == STOP) & ~np.isin(after, (SPACE, GAP, MARK, STOP)), SYMBOL, cls)
        chars = np.bincount(owner * k + cls, minlength=n * k).reshape(n, k)
        capitals = chars[:, UPPER] > chars[:, LOWER]
        cls = np.where(capitals[owner] & (cls <= UPPER), UPPER - cls, cls)
        first = np.append(True, (cls[1:] != cls[:-1]) | last[:-1])
        at = np.flatnonzero(first)
        size, of, who = np.diff(np.append(at, len(cls))), cls[at].astype(np.int64), owner[at]
        of = np.where((of == SPACE) & (size > 1) & (kinds[who] > 0), GAP, of)
        return np.bincount(who * k + of, weights=(size - 1) // LONG_RUN + 1, minlength=n * k).reshape(n, k)


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon divergence in bits of two count vectors; 1 if one of them is empty."""
    if p.sum() <= 0 or q.sum() <= 0:
        return 1.0
    return float(_divergences((p / p.sum())[None, :], (q / q.sum())[None, :])[0])


def _divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row, of distributions."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x: np.where(x > 0, x * np.log2(x / m), 0.0).sum(axis=1)
        return np.clip((part(p) + part(q)) / 2, 0.0, 1.0)


class _Language:
    def __init__(self, common: dict[str, list[str]]):
        self.names = sorted(common)
        self.words = [{w: i for i, w in enumerate(sorted(set(common[name])))} for name in self.names]
        self.of: dict[str, list[int]] = {}
        for n, index in enumerate(self.words):
            for w in index:
                self.of.setdefault(w, []).append(n)
        self.width = max((len(x) for x in self.words), default=0) + 1

    def best(self, counts: Counter) -> tuple[int, int, dict[str, int]]:
        """(place of the language whose function words cover most words, how many, the counts); -1 for none; ties go to the first name."""
        known = {w: k for w, k in counts.items() if w in self.of}
        if not known:
            return -1, 0, known
        n = [0] * len(self.names)
        for w, k in known.items():
            for lang in self.of[w]:
                n[lang] += k
        return n.index(max(n)), max(n), known


# Of each segment: kind, language, characters, words, then the runs of each class.
_HEAD = 4
_STATS = (
    "doc_id bigint, n_chars int, n_words int, n_lines int, mean_word_length double, symbol_ratio double, terminal_line_share double, "
    "common_word_share double, language string, word_divergence double, char_divergence double, prose_share double, list_share double, table_share double, junk_share double"
)
_PLAIN = ["doc_id", "n_chars", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "terminal_line_share", "common_word_share", "language"]
_COUNTED = ", ".join(x for x in _STATS.split(", ") if x.split()[0] in _PLAIN) + ", parts binary, known binary"


def _share(a: float, b: float) -> float:
    return a / b if b else 0.0


def _ends_a_sentence(line: str) -> bool:
    return line.rstrip(_CLOSERS)[-1:] in tuple(_STOPS)


def _count_batches(common: dict[str, list[str]]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        language, characters = _Language(common), _Characters()
        for batch in batches:
            texts = batch["text"].tolist()
            rows, parts, bodies, known_words = [], [], [], []
            for doc_id, text in zip(batch["doc_id"], texts):
                lines = [x for line in text.splitlines() if (x := line.strip())]
                found = segments(text)
                some = [_WORD.findall(body.lower()) for _, body in found]
                counts = [Counter(x) for x in some]
                if any(kind == 1 for kind, _ in found) or "REM" in text:  # letters may stand in bullets and prefixes
                    words = _WORD.findall(text.lower())
                    whole = Counter(words)
                else:
                    words = some[0] if len(some) == 1 else [w for x in some for w in x]
                    whole = counts[0] if len(some) == 1 else Counter(words)
                own, n_known, known = language.best(whole)
                for n, ((kind, body), own_words, count) in enumerate(zip(found, some, counts)):
                    lang, hits = (own, known) if count is whole else language.best(count)[::2]
                    lang = own if lang < 0 else lang
                    index = language.words[lang] if lang >= 0 else {}
                    known_words.append([(n, index[w], k) for w, k in hits.items() if w in index])
                    parts.append((kind, lang, len(body), len(own_words)))
                    bodies.append(body)
                ends = sum(map(_ends_a_sentence, lines))
                rows.append((doc_id, len(text), len(words), len(lines), _share(sum(map(len, words)), len(words)), _share(ends, len(lines)), _share(n_known, len(words)), language.names[own] if own >= 0 else None, len(found)))
            if not rows:
                continue
            head = np.array(parts, dtype=np.int32).reshape(len(parts), _HEAD)
            table = np.concatenate([head, characters.runs(bodies, head[:, 0])], axis=1).astype("<i4")
            out = pd.DataFrame(rows, columns=[c for c in _PLAIN if c != "symbol_ratio"] + ["n"])
            out["symbol_ratio"] = characters.symbol_counts(texts) / np.maximum(1, out["n_chars"].to_numpy())
            stop = out["n"].cumsum().tolist()
            start = [0, *stop[:-1]]
            out["parts"] = [table[a:b].tobytes() for a, b in zip(start, stop)]
            out["known"] = [np.array([x for w in known_words[a:b] for x in w], dtype="<i4").tobytes() for a, b in zip(start, stop)]
            yield out[[*_PLAIN, "parts", "known"]]

    return run


class _Batch:
    """The counts of a batch of documents: arrays of one entry a segment, and (segment, word, count) of its function words."""

    def __init__(self, batch: pd.DataFrame):
        width = _HEAD + len(CLASSES)
        tables = [np.frombuffer(x, dtype="<i4").reshape(-1, width) for x in batch["parts"]]
        sizes = [len(t) for t in tables]
        table = np.concatenate(tables) if tables else np.empty((0, width), dtype="<i4")
        self.owner = np.repeat(np.arange(len(tables)), sizes)
        self.kind, self.language, self.chars, self.n_words = (table[:, i].astype(np.int64) for i in range(_HEAD))
        self.runs = table[:, _HEAD:].astype(float)
        base = np.cumsum([0, *sizes[:-1]]) if sizes else []
        known = [np.frombuffer(x, dtype="<i4").reshape(-1, 3) + (b, 0, 0) for x, b in zip(batch["known"], base)]
        flat = np.concatenate(known).astype(np.int64) if known else np.empty((0, 3), dtype=np.int64)
        self.segment, self.word, self.times = flat.T
        self.n_known = np.bincount(self.segment, weights=self.times, minlength=len(table))

    def sums(self, chosen: np.ndarray, language: _Language) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words and of runs for each language over the chosen segments."""
        n = len(language.names)
        words, runs = np.zeros((n, language.width)), np.zeros((n, len(CLASSES)))
        of = chosen[self.segment]
        np.add.at(words, (self.language[self.segment[of]], self.word[of]), self.times[of])
        np.add.at(words[:, -1], self.language[chosen], (self.n_words - self.n_known)[chosen])
        np.add.at(runs, self.language[chosen], self.runs[chosen])
        return words, runs


def _profile_batches(common: dict[str, list[str]]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        language = _Language(common)
        n = len(language.names)
        words, runs = np.zeros((n, language.width)), np.zeros((n, len(CLASSES)))
        for batch in batches:
            b = _Batch(batch)
            more = b.sums((b.kind == 0) & (b.language >= 0) & (b.n_known > 0) & (b.runs[:, STOP] > 0), language)
            words, runs = words + more[0], runs + more[1]
        yield pd.DataFrame([(i, j, float(m[i, j]), kind) for kind, m in (("word", words), ("run", runs)) for i, j in zip(*np.nonzero(m))], columns=["language", "place", "n", "kind"])

    return run


class Profiles:
    """Distributions of the bands of function words and of class runs for each language. A text of an unknown language is held against the largest."""

    def __init__(self, words: np.ndarray, runs: np.ndarray):
        size = words.sum(axis=1)
        self.any = bool(size.sum() > 0)
        self.known = size > 0
        self.largest = int(size.argmax()) if len(size) else -1
        self.band = np.full(words.shape, BANDS)
        banded = np.zeros((len(words), BANDS + 1))
        for band, row, out in zip(self.band, words, banded):
            order = (-row[:-1]).argsort(kind="stable")
            before = row[order].cumsum() - row[order]
            band[order] = np.minimum(BANDS - 1, (before * BANDS / max(1.0, row[:-1].sum())).astype(int))
            np.add.at(out, band, row)
        self.words = banded / np.maximum(size, 1)[:, None]
        self.runs = runs / np.maximum(runs.sum(axis=1), 1)[:, None]

    def compare(self, language: np.ndarray, n_words: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray], runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word divergence as a share of that of as many words without a function word, class divergence) of each text.

        `known` are (text, word, count) of function words of the text's language. Counts are smoothed towards the profile, and
        as a few words or runs say little, divided by 1 + SMOOTHING / size.
        """
        if not self.any:
            return np.full(len(runs), np.inf), np.full(len(runs), np.inf)
        lang = np.where((language >= 0) & self.known[language], language, self.largest)
        words, none = np.zeros((len(runs), BANDS + 1)), np.zeros((len(runs), BANDS + 1))
        text, word, times = known
        np.add.at(words, (text, self.band[lang[text], word]), times)
        words[:, -1] = np.maximum(0, n_words - words[:, :-1].sum(axis=1))
        none[:, -1] = n_words
        most = self._smoothed(none, self.words[lang])
        weight = lambda x: 1 + SMOOTHING / np.maximum(x.sum(axis=1), 1)
        return self._smoothed(words, self.words[lang]) / np.maximum(most, 1e-9) / weight(words), self._smoothed(runs, self.runs[lang]) / weight(runs)

    @staticmethod
    def _smoothed(counts: np.ndarray, profile: np.ndarray) -> np.ndarray:
        return _divergences((counts + SMOOTHING * profile) / (counts.sum(axis=1) + SMOOTHING)[:, None], profile)


def language_profiles(counted: DataFrame, common: dict[str, list[str]]) -> Profiles:
    """Sums over the running text of all documents that holds a function word and a sentence end."""
    language = _Language(common)
    words, runs = np.zeros((len(language.names), language.width)), np.zeros((len(language.names), len(CLASSES)))
    rows = counted.select("parts", "known").mapInPandas(_profile_batches(common), "language int, place int, n double, kind string")
    for r in rows.groupBy("kind", "language", "place").agg(F.sum("n").alias("n")).collect():  # at most languages x (words + classes)
        (words if r["kind"] == "word" else runs)[r["language"], r["place"]] = r["n"]
    return Profiles(words, runs)


Limits = tuple[float, float]


def _judged(b: _Batch, profiles: Profiles, limits: Limits) -> np.ndarray:
    """The form of each segment, as its place in FORMS."""
    word, char = profiles.compare(b.language, b.n_words, (b.segment, b.word, b.times), b.runs)
    form = np.select([b.kind == 1, b.kind == 2], [1, 2], 3)
    # Items whose letters change case more often than blanks and signs part them are codes.
    form[(b.kind == 1) & (b.runs[:, UPPER] > b.runs[:, SPACE] + b.runs[:, GAP] + b.runs[:, SYMBOL])] = 3
    return np.where((word <= limits[0]) & (char <= limits[1]), 0, form)


def _verdict_batches(common: dict[str, list[str]], profiles: Profiles, limits: Limits) -> Callable:
    names = [x.split()[0] for x in _STATS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        language = _Language(common)
        place = {name: i for i, name in enumerate(language.names)}
        for batch in batches:
            b, n = _Batch(batch), len(batch)
            shares = np.zeros((n, len(FORMS)))
            np.add.at(shares, (b.owner, _judged(b, profiles, limits)), b.chars)
            shares /= np.maximum(1, shares.sum(axis=1))[:, None]
            own = batch["language"].map(place).fillna(-1).to_numpy(dtype=np.int64)
            runs = np.zeros((n, len(CLASSES)))
            np.add.at(runs, b.owner, b.runs)
            same = (b.language == own[b.owner])[b.segment]
            n_words = np.bincount(b.owner, weights=b.n_words, minlength=n)
            word, char = profiles.compare(own, n_words, (b.owner[b.segment[same]], b.word[same], b.times[same]), runs)
            out = batch[_PLAIN].copy()
            blank = (out["n_words"].to_numpy() == 0) & (runs.sum(axis=1) == 0)
            out["word_divergence"], out["char_divergence"] = np.where(blank, 1.0, np.minimum(word, 1.0)), np.where(blank, 1.0, np.minimum(char, 1.0))
            out[[f"{form}_share" for form in FORMS]] = shares
            yield out[names]

    return run


def _main_batches(profiles: Profiles) -> Callable:
    """The divergences of the largest segment of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            b = _Batch(batch)
            word, char = profiles.compare(b.language, b.n_words, (b.segment, b.word, b.times), b.runs)
            order = np.lexsort((-b.chars, b.owner))
            first = order[np.append(True, np.diff(b.owner[order]) > 0)] if len(order) else order
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[b.owner[first]], "word": word[first], "char": char[first]})

    return run


def fit_limit(prose: list[float], other: list[float], default: float) -> float:
    """The limit with the fewest labelled documents on its wrong side; of equal ones the middle of the widest, on a log scale."""
    if not prose or not other:
        return default
    value = np.log(np.maximum(np.array([*prose, *other], dtype=float), 1e-6))
    is_prose = np.array([True] * len(prose) + [False] * len(other))
    order = value.argsort(kind="stable")
    value, is_prose = value[order], is_prose[order]
    wrong = np.r_[0, np.cumsum(~is_prose)] + (is_prose.sum() - np.r_[0, np.cumsum(is_prose)])  # the first i are called prose
    gap = np.r_[0.0, np.diff(value), 0.0]
    i = max(np.flatnonzero(wrong == wrong.min()), key=lambda x: (gap[x], -x))
    return float(np.exp((value[i - 1] + value[i]) / 2)) if 0 < i < len(value) else default


def structural_profiles(stats: DataFrame, labels: DataFrame | None) -> dict[str, list[float]]:
    """Mean shares of the documents of each labelled form; a form without labels is its pure self."""
    out = {form: [float(form == other) for other in FORMS] for form in FORMS}
    if labels is not None:
        columns = [f"{form}_share" for form in FORMS]
        means = stats.join(F.broadcast(labels), "doc_id").groupBy("text_form").agg(*[F.avg(c).alias(c) for c in columns])
        out |= {r["text_form"]: [r[c] for c in columns] for r in means.collect()}
    return out


def text_statistics(documents: DataFrame, common_words: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, the counts and shares of `_STATS`, text_form and is_prose for every document.

    Shares are of the segments' characters; the two divergences are the whole document's (the first as a share of that
    of a text without function words), at most 1. Null texts count as empty, rows without an id are left out,
    repeated rows stay. An empty or blank text has no prose: zero shares and the form junk. `language` is the one whose
    function words cover most words, not the column `lang`, which is unreliable; null where none occurs. Without
    any function word in all documents nothing is prose.
    """
    rows = common_words.select(F.lower("lang").alias("lang"), F.lower("word").alias("word")).where(F.col("lang").isNotNull() & F.col("word").isNotNull()).distinct().limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError("common_words is a short list of function words")
    common: dict[str, list[str]] = {}
    for r in rows:
        common.setdefault(r["lang"], []).append(r["word"])
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.col("doc_id").isNotNull())
    counted = cut(spread(docs).mapInPandas(_count_batches(common), _COUNTED))
    profiles = language_profiles(counted, common)
    limits, near = (WORD_LIMIT, CHAR_LIMIT), structural_profiles(counted, None)
    if labels is not None:
        some = labels.select("doc_id", "text_form").where(F.col("doc_id").isNotNull() & F.col("text_form").isin(*FORMS)).distinct().limit(MOST_LABELS)
        labelled = counted.join(F.broadcast(some.select("doc_id").distinct()), "doc_id", "left_semi")
        main = labelled.mapInPandas(_main_batches(profiles), "doc_id bigint, word double, char double").join(F.broadcast(some), "doc_id").collect()  # at most MOST_LABELS
        limits = _fitted(main)
        near = structural_profiles(labelled.mapInPandas(_verdict_batches(common, profiles, limits), _STATS), some)
    stats = counted.mapInPandas(_verdict_batches(common, profiles, limits), _STATS)
    distance = {form: sum(((F.col(f"{other}_share") - F.lit(v)) ** 2 for other, v in zip(FORMS, near[form])), F.lit(0.0)) for form in FORMS}
    least = F.least(*distance.values())
    form = F.when(F.col("prose_share") + F.col("list_share") + F.col("table_share") + F.col("junk_share") == 0, "junk")
    for name in FORMS:
        form = form.when(distance[name] == least, name)
    return stats.withColumn("text_form", form).withColumn("is_prose", F.col("text_form") == "prose")


def _fitted(main: list) -> Limits:
    """The class limit parts labelled prose from the rest; the word limit lies midway between labelled prose and text without function words."""
    prose = [r for r in main if r["text_form"] == "prose"]
    char = fit_limit([r["char"] for r in prose], [r["char"] for r in main if r["text_form"] != "prose"], CHAR_LIMIT)
    word = (1 + float(np.quantile([r["word"] for r in prose], 0.95))) / 2 if prose else WORD_LIMIT
    return word, char
