"""Credentials in chunk texts (problem 6).

Detectors look for secret values by format (cloud and service tokens, signed web tokens), by place (URL logins,
private key blocks, machine/login/password lines) and by name (a value that looks random next to a name such as
password, token or key). Literals in base64 (also wrapped over lines), hex, percent or backslash escapes are decoded and
scanned again until nothing decodes; a hit inside marks the enclosing literal. Binary literals and the bodies of key
blocks are parsed as key containers by their grammar (DER: PKCS#1, PKCS#8 plain and encrypted, SEC1, PKCS#12; OpenSSH): a
private one is a secret, a public one is not. A key block whose body does not parse, as where a chunk border cut it,
counts by its markers.

Redaction replaces only the characters of the values, so quotes, separators and line structure stay.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

MARK = "REDACTED"


class Hit(NamedTuple):
    start: int
    end: int
    kind: str


# Fixed formats of published token kinds.
_FORMATS = re.compile(
    r"(?<![A-Za-z0-9])(?:"
    r"(?P<aws>(?:AKIA|ASIA)[0-9A-Z]{16})"
    r"|(?P<github>gh[pousr]_[A-Za-z0-9]{30,})"
    r"|(?P<stripe>[sr]k_live_[A-Za-z0-9]{16,})"
    r"|(?P<slack>xox[abeprs]-[0-9A-Za-z-]{16,})"
    r"|(?P<gitlab>glpat-[0-9A-Za-z_-]{20,})"
    r"|(?P<google>AIza[0-9A-Za-z_-]{35})"
    r"|(?P<jwt>eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,})"
    r")(?![A-Za-z0-9])"
)
_URL = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.-]{1,20}://([^\s:/@\"'<>]*):([^\s/@\"'<>]+)@(?=[A-Za-z0-9\[_.-])")
_USER_FLAG = re.compile(r"(?:^|\s)(?:-u|--user)[ =][\"']?([^\s:\"']+):([^\s\"']+)")

# What follows a name: rest of the name, closing quotes, a separator, opening quotes, the value.
_AFTER = re.compile(
    r"(?i)[\w.-]{0,120}\\{0,3}(?P<close>[\"'`\])]{0,2})[ \t]*(?P<sep>:=|=>|==?|:|,|(?:is|as|by|ist|es|lautet)\b|(?=[ \t\"'`]))[ \t]*"
    r"[(\[{]?(?:[bru]?\\{0,3}(?P<quote>[\"'`]))?(?:(?:Bearer|Basic)[ ]+)?(?P<value>[^\s\"'`,;<>]{6,600})"
)
# The whole of a longer value; inside one that was read from an earlier name, up to the next separator.
_LONG = re.compile(r"[^\s\"'`,;<>]+")
_LONG_INSIDE = re.compile(r"[^\s\"'`,;<>&=:]+={0,2}")
_SQL = re.compile(r"(?i)\b(?:PASSWORD|IDENTIFIED\s+BY)\s+'(?P<value>[^']{6,})'")
_SECURE = re.compile(r"(?i)ConvertTo-SecureString\s+(?:-String\s+)?[\"'](?P<value>[^\"']{6,})[\"']")
_LOGIN = re.compile(r"(?i)\b(?:login|account|user(?:name)?|credentials?|anmeldung|zugang|cuenta|usuario|acceso|логин\w*|вход\w*|учётн\w+|учетн\w+)\b[^\n]{0,60}?(?:\s/\s|:|\bas\b)\s*[`\"']?(?P<value>[^\s`\"',;]{8,})")
_JOINED = re.compile(r"[\"']([^\"'\n]{2,})[\"'](?:\s*(?:\+|\.|\\)?\s*[\"']([^\"'\n]{2,})[\"'])+")
_PIECE = re.compile(r"[\"']([^\"'\n]*)[\"']")

_BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END ((?:[A-Z0-9]+ )*)PRIVATE KEY(?: BLOCK)?-----")
# Body characters: long runs anywhere, and a short last line by itself.
_BODY = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{16,}={0,2}|(?m:^[ \t\"'#*/+]*)(?P<last>[A-Za-z0-9+/]{2,}={1,2}|[A-Za-z0-9+/]{4,})(?m:[ \t\"'+,]*\r?$)")
_KEY_LINE = re.compile(r"\s*(?:[#*/\-\"'+ ]{0,6})([A-Za-z0-9+/]{16,}={0,2})(?:[\"'\\n,+ ]*\r?$|(?<=[A-Za-z0-9+/=]{40}) )")
_HEADER_LINE = re.compile(r"\s*(?:Proc-Type|DEK-Info|Comment|Version):")

_B64 = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z0-9+/]{12,}={0,2}|[A-Za-z0-9_-]{16,}={0,2})(?![A-Za-z0-9+/_=-])")
_HEX = re.compile(r"(?<![A-Za-z0-9])(?:0x)?((?:[0-9a-f]{2}){8,}|(?:[0-9A-F]{2}){8,})(?![A-Za-z0-9])")
_HEX_RUN = re.compile(r"[0-9a-fA-F]{16}")
_PERCENT = re.compile(r"(?<![A-Za-z0-9._~+=/@:!$&*%-])[A-Za-z0-9._~+=/@:!$&*-]*(?:%[0-9A-Fa-f]{2}[A-Za-z0-9._~+=/@:!$&*-]*){2,}")
_PERCENT_AGAIN = re.compile(r"%(?:25)+(?=[0-9A-Fa-f]{2})")  # layers of percent escapes alone, however many
_ESCAPED = re.compile(r"(?:\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\[0-7]{3}){4,}")

_PLACEHOLDER = re.compile(
    r"(?i)^(?:\$|%\(|%[A-Z_]+%|\{|<|\[|@|\*+$|x+$|\.+$|your|my[-_]|insert|replace|change[-_]?me|todo|fixme|dummy|sample|none$|null$|true$|false$|secret$|password$|token$|vault[:/]|env[:.]|file:|ref:|arn:|sha\d+[:\-]|md5[:\-]|https?://[^:@]*$)|example|placeholder|redacted|changeme|replace_me|not[-_]?real|your[-_]"
)
_CHECKSUM_NAME = re.compile(r"(?i)digest|checksum|hash|sha\d*\b|md5|fingerprint|integrity|etag|commit|revision|uuid|_id$|_ref$")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
_HEXES = re.compile(r"^(?:[0-9a-f]+|[0-9A-F]+)$")
_CALL = re.compile(r"[(\[{]|\)$|::|->|\$\{|^[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)+$")
# Words that open a search, by what is searched for around them.
_WORDS = {
    "name": "password passwd passphrase pass_phrase pass_phase passcode smtp_pass _pass pwd secret token api_key api-key apikey access_key access-key accesskey private_key private-key privatekey signing_key signing-key encryption_key auth_key -key credential _cred cred bearer authorization dsn пароль парол секрет токен ключ passwort kennwort geheimnis schlüssel contraseña clave secreto".split(),
    "format": "akia asia ghp_ gho_ ghu_ ghs_ ghr_ sk_live_ rk_live_ xoxa- xoxb- xoxe- xoxp- xoxr- xoxs- glpat- aiza eyj".split(),
    "url": ["://"],
    "user_flag": [" -u", "--user"],
    "sql": ["password '", "identified"],
    "secure": ["converttosecurestring", "convertto-securestring"],
    "login": "login account user credentials anmeldung zugang cuenta usuario acceso логин вход учётн учетн".split(),
}
_FINDER = ahocorasick.Automaton()
for _what, _words in _WORDS.items():
    for _word in _words:
        _FINDER.add_word(_word, (_what, len(_word)))
_FINDER.make_automaton()
_LITERAL = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
_LITERAL_CHAR = re.compile(r"[A-Za-z0-9+/_-]")
_UNREADABLE = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_NAME_BEFORE = re.compile(r"[\w.$:-]*\Z")


# Letters as words have them: a first cluster, vowels between clusters, a last cluster.
_WORDLIKE = re.compile(
    r"(?:[b-df-hj-np-tv-z]|[bcfgkps]l|[bcdfgkptw]r|[cgpstw]h|s[ckmnptvw]|sch|s[cpt]r|s[hp][lr]|[dst]w|[gkp]n|ps|qu|squ|thr|chr|ts|zw)?[aeiouy]+(?:[b-df-hj-np-tv-z]{1,4}[aeiouy]+)*"
    r"(?:[b-df-ik-np-tw-z]|ff|ll|ss|tt|zz|gg|nn|rr|mm|dd|mn|dth|phs|ngth|[cgpst]h|[dlnrs]t|ck|ct|ft|pt|xt|ght|tch|cht|sch|l[dfkmp]|lth|m[bp]|mpt|n[dgkcs]|n[ct]h|r[bcdfgklmnp]|r[ct]h|s[kmp]|t[sz]|w[nlk]|[bcdfgklmnprtw]s|(?:c[kt]|n[dgkt]|r[dkt]|ld|st|th)s)?"
)
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SHORT_WORDS = frozenset(
    "a an as at be by do go if in is it me my no of ok on or to up us we api arg args attr aws btn cfg cli cmd cpu css csv ctx db dns dst env fn gpu html http https id idx io ip json jwt len md mgr msg num obj os passwd pdf ptr pwd ref rsa req res sdk sql src srv ssh ssl stderr stdin stdout str svc tcp tls tmp ui uri url utf uuid val var xml yaml".split()
)
_SEPARATORS = re.compile(r"[-_./=:,\\ ]+")


def _is_words(part: str) -> bool:
    """Whether the letters are mostly words, as in camel case and constants. Letters beyond ASCII are taken for words."""
    if not part.isascii():
        return True
    pieces = [x.lower() for x in _CAMEL.findall(part)]
    return sum(len(x) for x in pieces if x in _SHORT_WORDS or (len(x) > 2 and _WORDLIKE.fullmatch(x))) > 0.7 * sum(map(len, pieces))


def _is_mixed(value: str) -> bool:
    """Whether parts that are no words, numbers or short tags make up a value that keeps changing between two classes."""
    parts = [x for x in _SEPARATORS.split(value) if not x.isdigit() and not (len(x) < 6 and (x.islower() or x.isupper())) and not (_CAMEL.search(x) and _is_words(x))]
    size, turns = sum(map(len, parts)), sum(_kind(a) != _kind(b) for x in parts for a, b in zip(x, x[1:]))
    return size >= 8 and (turns >= 3 or (turns == 2 and size >= 12 and len(set("".join(parts))) >= 10))


def looks_random(value: str, name: str = "", strong: bool = False) -> bool:
    """A value no person writes as a word, path, variable, checksum or identifier.

    At a strong place (a login, a secret's name, an encoded literal) two of lower case, upper case and digits, or one
    with symbols, are enough: a random password often lacks one.
    """
    if len(value) < 8 or len(set(value)) < 6 or _PLACEHOLDER.search(value) or _UUID.match(value) or _CALL.search(value):
        return False
    if _HEXES.match(value):
        return len(value) >= 20 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and not (_CHECKSUM_NAME.search(name) if name else len(value) in (64, 96, 128))
    lower, upper, digit = (any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit))
    if lower + upper + digit < 3:
        return strong and _is_mixed(value)
    if re.fullmatch(r"[A-Za-z]+(?:[-_ /.][A-Za-z]+)*[-_ .v]?\d{1,3}", value):  # words with a number behind
        return False
    turns = sum(_kind(a) != _kind(b) for a, b in zip(value, value[1:]))
    return turns >= 3


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


_OPENSSH = b"openssh-key-v1\0"
_PKCS7 = b"\x2a\x86\x48\x86\xf7\x0d\x01\x07"  # the object identifier that PKCS#12 content begins with


def key_container(raw: bytes) -> str | None:
    """'private' or 'public' if the bytes are a key by their binary grammar, else None."""
    kind = container_kind(raw)
    return kind and kind.split(" ")[0]


def container_kind(raw: bytes) -> str | None:
    """Side and format of a key container: `private pkcs8`, `public spki`; None if no grammar fits."""
    if raw.startswith(_OPENSSH):
        return "private openssh" if _is_openssh(raw) else None
    if raw[:4] in (b"\0\0\0\x07", b"\0\0\0\x0b", b"\0\0\0\x13") and _ssh_fields(raw, 0, 2) is not None and raw[4:].startswith((b"ssh-", b"ecdsa-")):
        return "public ssh"
    outer = _der(raw, 0)
    if outer is None or outer[0] != 0x30 or outer[2] > len(raw):
        return None
    parts, at = [], outer[1]
    while at < outer[2]:
        part = _der(raw, at)
        if part is None or part[2] > outer[2]:
            return None
        parts.append((part[0], raw[part[1] : part[2]]))
        at = part[2]
    tags = [t for t, _ in parts]
    if tags[:2] == [0x30, 0x03]:
        return "public spki"
    if tags == [0x02, 0x02]:
        return "public pkcs1"
    if tags[:3] == [0x02, 0x30, 0x04]:
        return "private pkcs8"
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return "private pkcs1"
    if tags[:2] == [0x02, 0x04] and parts[0][1] == b"\x01":
        return "private sec1"
    if tags[:2] == [0x02, 0x30] and parts[0][1] == b"\x03" and _PKCS7 in parts[1][1][:24]:
        return "private pkcs12"
    if tags[:2] == [0x30, 0x04]:
        return "private encrypted"
    return None


def _ssh_fields(raw: bytes, at: int, n: int) -> int | None:
    """Where the n length-prefixed fields at `at` end; None if they do not fit."""
    for _ in range(n):
        if at + 4 > len(raw):
            return None
        at += 4 + int.from_bytes(raw[at : at + 4], "big")
    return at if at <= len(raw) else None


def _is_openssh(raw: bytes) -> bool:
    """Cipher, key derivation and its options, the number of keys, each public key, and the private part."""
    at = _ssh_fields(raw, len(_OPENSSH), 3)
    if at is None or at + 4 > len(raw):
        return False
    keys = int.from_bytes(raw[at : at + 4], "big")
    return 0 < keys <= len(raw) // 4 and _ssh_fields(raw, at + 4, keys + 1) is not None


def _der(raw: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, value start, value end) of the element at `at`."""
    if at + 2 > len(raw):
        return None
    tag, n, at = raw[at], raw[at + 1], at + 2
    if n & 0x80:
        more = n & 0x7F
        if not 1 <= more <= 4 or at + more > len(raw):
            return None
        n, at = int.from_bytes(raw[at : at + more], "big"), at + more
    return tag, at, at + n


def _readable(raw: bytes) -> str | None:
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if len(text) >= 6 and all(c.isprintable() or c in "\r\n\t" for c in text) else None


def _may_be_base64(s: str) -> bool:
    return not (s.islower() or (s.isupper() and not s.endswith("=")) or _HEXES.match(s))


def _unpadded(bare: str) -> bytes:
    return base64.b64decode(bare + "=" * (-len(bare) % 4))


def _after_prefix(s: str, bare: str) -> Iterator[tuple[int, bytes]]:
    """(start, content) of what follows a `-` or `_` and decodes to text or begins like a key container.

    Places that are a multiple of four apart decode to the same bytes, so four decodings serve all of them.
    """
    for turn in range(4):
        starts = [i + 1 for i in range(turn, len(bare) - 12, 4) if s[i] in "-_"]
        if not starts or (len(bare) - starts[0]) % 4 == 1:
            continue
        raw = _unpadded(bare[starts[0] :])
        bad = max((m.start() for m in _UNREADABLE.finditer(raw)), default=-1)
        for at in starts:
            lo = (at - starts[0]) // 4 * 3
            if raw[lo] == 0x30 or raw.startswith(_OPENSSH, lo):
                yield at, raw[lo:]
            if lo > bad:
                try:
                    raw[lo:].decode()
                except UnicodeDecodeError as e:
                    bad = lo + e.start
                    continue
                if _may_be_base64(s[at:]):
                    yield at, raw[lo:]
                break


def _decoded(text: str) -> Iterator[tuple[int, int, str | bytes]]:
    """(start, end, content) of literals that decode, one layer."""
    for m in _HEX.finditer(text) if _HEX_RUN.search(text) else ():
        if m.end(1) - m.start(1) not in (32, 40, 64, 96, 128) or m.end(1) - m.start(1) > 512:
            yield m.start(), m.end(), bytes.fromhex(m[1])
        else:
            raw = bytes.fromhex(m[1])
            if _readable(raw):
                yield m.start(), m.end(), raw
    for m in _LITERAL.finditer(text):
        start, end, s = m.start(), m.end(), m[0]
        if s[-1] == "=" and _LITERAL_CHAR.match(text, end):
            s = s.rstrip("=")  # it stands between a name and a value
            end = start + len(s)
        if not _may_be_base64(s):
            continue
        bare = s.rstrip("=").replace("-", "+").replace("_", "/")
        if _B64.fullmatch(s) and len(bare) % 4 != 1:
            yield start, end, _unpadded(bare)
        for at, raw in _after_prefix(s, bare) if "-" in s or "_" in s else ():
            yield start + at, end, raw
    for m in _PERCENT.finditer(text) if "%" in text else ():
        yield m.start(), m.end(), unquote(_PERCENT_AGAIN.sub("%", m[0]))
    for m in _ESCAPED.finditer(text) if "\\" in text else ():
        try:
            yield m.start(), m.end(), m[0].encode("ascii", "ignore").decode("unicode_escape")
        except UnicodeDecodeError:
            pass


_WRAP = re.compile(r"[A-Za-z0-9+/_-]{16}[\"'\\+, \t]*\r?\n[ \t\"'#*+]*[A-Za-z0-9+/_-]")
_WRAP_HEAD = re.compile(r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{16,})[\"'\\+, \t]*\r?\Z")
_WRAP_LINE = re.compile(r"[ \t\"'#*+]*([A-Za-z0-9+/_-]+={0,2})[\"'\\+,;)\]} \t]*\r?\Z")


def _wrapped(text: str) -> Iterator[tuple[list[tuple[int, int]], bytes]]:
    """(spans of the pieces, content) of base64 literals that go on over lines."""
    if not _WRAP.search(text):
        return
    at, spans = 0, []

    def ended() -> Iterator[tuple[list[tuple[int, int]], bytes]]:
        bare = "".join(text[lo:hi] for lo, hi in spans).rstrip("=").replace("-", "+").replace("_", "/")
        if len(spans) > 1 and len(bare) % 4 != 1 and _may_be_base64(bare):
            yield spans, _unpadded(bare)

    for line in text.split("\n"):
        going = _WRAP_LINE.match(line) if spans else None
        if going:
            spans.append((at + going.start(1), at + going.end(1)))
        if not going or going[1].endswith("="):
            yield from ended()
            spans = []
        if not going:
            head = _WRAP_HEAD.search(line)
            spans = [(at + head.start(1), at + head.end(1))] if head else []
        at += len(line) + 1
    yield from ended()


def _is_secret(content: str | bytes, literal: str) -> str | None:
    """The kind of a decoded content that is a secret or holds one."""
    if isinstance(content, bytes):
        plain = _readable(content)
        if plain is None:
            return "key_container" if key_container(content) == "private" else None
    else:
        plain = content
    if plain and plain != literal and (looks_random(plain.strip(), strong=True) or any(True for _ in _scan(plain))):
        return "encoded"
    return None


def _layers(text: str) -> Iterator[Hit]:
    for start, end, content in _decoded(text):
        kind = _is_secret(content, text[start:end])
        if kind:
            yield Hit(start, end, kind)
    for spans, content in _wrapped(text):
        kind = _is_secret(content, "")
        if kind:
            yield from (Hit(lo, hi, kind) for lo, hi in spans)


def _body_kind(body: str) -> str | None:
    """What the base64 lines of a key block are by their grammar: private_key with its format, or None for a public one."""
    bare = "".join(re.findall(r"(?m)^[ \t\"'#*/+]*([A-Za-z0-9+/]+={0,2})[ \t\"'+,]*\r?$", body)).rstrip("=")
    found = container_kind(_unpadded(bare)) if len(bare) % 4 != 1 else None
    if found is None:
        return "private_key"
    return f"private_key {found.split(' ')[1]}" if found.startswith("private") else None


def _key_blocks(text: str) -> Iterator[Hit]:
    """Body characters of private key blocks, also where a chunk border cut off one of the marker lines."""
    ends = [(m.start(), m.end()) for m in _END.finditer(text)]
    at = 0
    for m in _BEGIN.finditer(text):
        stop = next((s for s, _ in ends if s >= m.end()), None)
        following = _BEGIN.search(text, m.end())
        if stop is not None and (following is None or stop < following.start()):
            kind = _body_kind(text[m.end() : stop].replace("\\n", "\n"))
            for b in _BODY.finditer(re.sub(r"\\[nrt]", "  ", text[m.end() : stop])) if kind else ():
                lo, hi = b.span("last") if b["last"] else b.span()
                yield Hit(m.end() + lo, m.end() + hi, kind)
            at = stop
            continue
        pos = m.end()
        for line in text[pos:].split("\n")[0 if text[pos : pos + 1] != "\n" else 1 :]:
            pos = text.index(line, pos) if line else pos
            k = _KEY_LINE.match(line)
            if k:
                yield Hit(pos + k.start(1), pos + k.end(1), "private_key")
            elif line.strip() and not _HEADER_LINE.match(line):
                break
            pos += len(line)
        at = pos
    for start, _ in ends:
        if _BEGIN.search(text, 0, start) and start <= at:
            continue
        before = text.rfind("\n", 0, start) + 1
        while before > 0:
            lo = text.rfind("\n", 0, before - 1) + 1
            k = _KEY_LINE.match(text[lo : before - 1])
            if not k:
                break
            yield Hit(lo + k.start(1), lo + k.end(1), "private_key")
            before = lo


def _lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _login_value(m: re.Match) -> tuple[str, int]:
    value = m["value"].rstrip(".)")
    return value, m.start("value")


def _scan(text: str) -> Iterator[Hit]:
    if "PRIVATE KEY" in text:
        yield from _key_blocks(text)
    done: set[tuple[str, int]] = set()
    read = {"value": 0, "pieces": 0}
    for last, (what, size) in _FINDER.iter(_lowered(text)):
        end = last + 1
        if what == "name":
            yield from _named(text, end - size, end, read)
            continue
        if what == "format":
            m = _FORMATS.match(text, end - size)
            if m and len(set(m[0][4:])) >= 6 and not _PLACEHOLDER.search(m[0]):
                yield Hit(m.start(), m.end(), m.lastgroup)
            continue
        lo = text.rfind("\n", 0, end - size + 1) + 1
        if (what, lo) in done:
            continue
        done.add((what, lo))
        hi = text.find("\n", end)
        hi = len(text) if hi < 0 else hi
        if what in ("url", "user_flag"):
            for m in (_URL if what == "url" else _USER_FLAG).finditer(text, lo, hi):
                value = unquote(m[2])
                if value != m[1] and len(value) >= 6 and not _PLACEHOLDER.search(value) and not re.search(r"[(\[{]", value) and (re.search(r"\d", value) or len({_kind(c) for c in value}) > 1):
                    yield Hit(m.start(2), m.end(2), "url_login")
            continue
        for m in {"sql": _SQL, "secure": _SECURE, "login": _LOGIN}[what].finditer(text, lo, hi):
            value, start = _login_value(m)
            if looks_random(value, strong=True) and not _HEXES.match(value):
                yield Hit(start, start + len(value), {"sql": "sql_login", "secure": "password", "login": "login"}[what])
    yield from _layers(text)


def _named(text: str, begin: int, end: int, read: dict[str, int]) -> Iterator[Hit]:
    """read: how far long values and joined pieces were read from earlier names, so that no long line is read again for each name."""
    m = _AFTER.match(text, end)
    if not m or (m["sep"] == "," and not m["close"]):
        return
    line = text.rfind("\n", 0, begin) + 1
    name = _NAME_BEFORE.search(text, max(line, begin - 80), begin)[0] + text[begin : m.start("close")]
    if text[begin] == "-" and not name.lower().startswith("x-"):
        return
    value, start = m["value"], m.start("value")
    if len(value) == 600:
        value = (_LONG_INSIDE if start < read["value"] else _LONG).match(text, start)[0]
        read["value"] = max(read["value"], start + len(value))
    line_end = text.find("\n", start)
    line_end = len(text) if line_end < 0 else line_end
    joined = _JOINED.match(text, m.start("quote"), min(line_end, start + 600) if start < read["pieces"] else line_end) if m["quote"] in ("'", '"') else None
    if joined:
        read["pieces"] = max(read["pieces"], joined.end())
        pieces = list(_PIECE.finditer(text, joined.start(), joined.end()))
        whole = "".join(p[1] for p in pieces)
        if looks_random(whole, name, True) or _FORMATS.fullmatch(whole):
            for p in pieces:
                yield Hit(p.start(1), p.end(1), "secret")
        return
    if m["quote"]:
        close = text.find(m["quote"], start, line_end)
        whole = text[start:close] if close > start else value
        value = value if re.search(r"\s", whole) else whole
    else:
        value = value.rstrip(").]}")
    value = value.rstrip("\\")
    if "://" in value or not looks_random(value, name, True):
        return
    yield Hit(start, start + len(value), "secret")


def find_in_text(text: str) -> list[Hit]:
    """Merged, sorted spans of secret characters. The kind of a merged span is that of a key block, else of its first hit."""
    out: list[Hit] = []
    for h in sorted(h for h in set(_scan(text)) if text[h.start : h.end] != MARK):
        if out and h.start < out[-1].end:
            out[-1] = Hit(out[-1].start, max(out[-1].end, h.end), h.kind if h.kind.startswith("private_key") else out[-1].kind)
        else:
            out.append(h)
    return out


def redact_text(text: str, hits: list[Hit]) -> str:
    """Each value becomes MARK; all other characters stay. Redacting again changes nothing."""
    out, at = [], 0
    for h in hits:
        out += [text[at : h.start], MARK]
        at = h.end
    return "".join([*out, text[at:]])


def _find_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for cid, text in zip(batch["chunk_id"], batch["text"]):
            for h in find_in_text(text):
                first = text.count("\n", 0, h.start) + 1
                for n in range(first, first + text.count("\n", h.start, h.end) + 1):
                    out.append((cid, n, h.start, h.end, h.kind))
        yield pd.DataFrame(out, columns=["chunk_id", "line_no", "start_char", "end_char", "kind"])


def find_secrets(chunks: DataFrame) -> DataFrame:
    """chunk_id, line_no, start_char, end_char, kind of each secret, once for a repeated chunk.

    Lines are split at `\\n` and count from 1; offsets are code points. Null texts and ids are left out.
    """
    rows = chunks.select("chunk_id", "text").where(F.col("chunk_id").isNotNull() & F.col("text").isNotNull())
    return spread(rows).mapInPandas(_find_batches, "chunk_id string, line_no int, start_char int, end_char int, kind string").distinct()


def _redact_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [find_in_text(t) for t in batch["text"]]
        yield pd.DataFrame({"chunk_id": batch["chunk_id"], "text": [redact_text(t, h) for t, h in zip(batch["text"], found)], "n_secrets": [len(h) for h in found]})


def redact(chunks: DataFrame) -> DataFrame:
    """chunk_id, text, n_secrets: every chunk row with a text, secrets replaced, nothing else changed."""
    rows = chunks.select("chunk_id", "text").where(F.col("text").isNotNull())
    return spread(rows).mapInPandas(_redact_batches, "chunk_id string, text string, n_secrets int")
