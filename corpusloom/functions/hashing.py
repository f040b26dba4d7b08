"""Identities of chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def point_id(path: Column, locator: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", path, locator, text), 256)


def storage_uuid(chunk_id: Column) -> Column:
    """UUID version 5 of the id in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(_URL_NAMESPACE)), F.encode(chunk_id, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))
