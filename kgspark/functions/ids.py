"""Identifiers and checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgspark.functions.text import id_name, normalize_name, trim


def uuid_like(c: Column) -> Column:
    """First 32 hex digits of SHA-256 in groups of 8-4-4-4-12."""
    h = F.sha2(c, 256)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def entity_id(kind: Column, name: Column) -> Column:
    return uuid_like(F.concat(kind, F.lit(":"), id_name(name)))


def relationship_id(source: Column, kind: Column, target: Column) -> Column:
    return uuid_like(F.concat(source, F.lit(":"), kind, F.lit(":"), target))


def relationship_key(source: Column, kind: Column, target: Column) -> Column:
    """Key under which equal relationships of different records meet."""
    return F.concat_ws("|", id_name(source), kind, id_name(target))


def record_id(source: Column, kind: Column, source_id: Column) -> Column:
    return F.concat_ws("_", source, kind, source_id)


def config_entity_id(source: Column, kind: Column, value: Column) -> Column:
    """Id of an entity that a configuration extracts."""
    return F.concat_ws("_", source, F.lower(kind), value)


def content_checksum(title: Column, content: Column) -> Column:
    """SHA-256 of the trimmed title and content, by which changes are detected."""
    return F.sha2(trim(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit("")))), 256)


def raw_checksum(raw: Column) -> Column:
    return F.sha2(raw, 256)


def json_text(c: Column) -> Column:
    """A text as JSON writes it: quotes, backslashes and control characters escaped, all else as it is."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(code, f"\\u{code:04x}")
        out = F.replace(out, F.lit(chr(code)), F.lit(short))
    return F.concat(F.lit('"'), out, F.lit('"'))


def embedding_checksum(**fields: Column) -> Column:
    """SHA-256 of JSON of the given texts, lower-cased and trimmed; fields without a text are left out."""
    parts = [F.concat(F.lit(f'"{k}":'), json_text(F.nullif(trim(F.lower(c)), F.lit("")))) for k, c in fields.items()]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)
