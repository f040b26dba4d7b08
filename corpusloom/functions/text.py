"""Text expressions that agree with Python's string rules and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What splitlines() and split() take as separators, and the tokens of lexical search.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
TOKEN = r"[A-Za-zА-Яа-я0-9_./:-]+"


def lines(text: Column) -> Column:
    """splitlines(): no element for a final line break."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{BLANK[1:]}")


def snippet(text: Column, limit: int = 280) -> Column:
    """Blanks collapsed and trimmed; a longer text keeps limit - 3 characters, right-trimmed, and an ellipsis."""
    flat = strip(F.regexp_replace(text, rf"{BLANK}+", " "))
    head = F.regexp_replace(F.substring(flat, 1, limit - 3), rf"{BLANK}+\z", "")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(head, F.lit("...")))


def tokens(text: Column) -> Column:
    """Lower-cased search tokens in order; null for a null text.

    Lowering first saves a lambda over every token. Only two characters outside the token class have a lower case
    inside it (dotted capital I and the Kelvin sign), so they are blanked before.
    """
    return F.regexp_extract_all(F.lower(F.translate(text, "\u0130\u212a", "  ")), F.lit(TOKEN), F.lit(0))


def document_prompt(text: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), text) if prefix else text


def query_prompt(text: Column, template: str) -> Column:
    return F.replace(F.lit(template), F.lit("{query}"), text)


def payload_bytes(text: Column, path: Column, language: Column, chunk_type: Column, tags: Column, dimension: int) -> Column:
    """Size estimate of a stored row in bytes."""
    return sum((F.octet_length(c) for c in (text, path, language, chunk_type, F.array_join(tags, ""))), F.lit(16 * dimension + 2048))
