"""Raw JSON records to unified records: routing, mapping, ids, checksums, extraction of entities and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions import json as J
from kgspark.functions.dates import coerce, parse_date
from kgspark.functions.ids import config_entity_id, content_checksum, record_id
from kgspark.functions.markup import PROCESSORS, RICH
from kgspark.functions.text import truthy
from kgspark.sources.config import RecordType, SyncConfig

#: Fields that may hold a record's own id, in order; fixed values.
ID_FIELDS = ["id", "_id", "sourceId", "recordId", "uuid", "guid", "gid"]
LINK_FIELDS = ["url", "uri"]


def unwrap(raw: DataFrame, array_path: str | None = None) -> DataFrame:
    """Rows (ord, raw) of responses: arrays, or the list under a path or a usual name, exploded; else the object (A3)."""
    lists = [J.value(F.col("raw"), array_path)] if array_path else []
    lists += [F.get_json_object("raw", f"$.{n}") for n in ("content", "results", "records", "data")]
    whole = F.when(F.col("raw").rlike(r"^\s*\["), F.col("raw"))
    listed = F.coalesce(whole, *[F.when(x.rlike(r"^\s*\["), x) for x in lists])
    items = F.transform(F.from_json(listed, "array<variant>"), lambda v: F.to_json(v))
    one = F.when(listed.isNotNull(), items).otherwise(F.array("raw"))
    rest = [c for c in raw.columns if c != "raw"]
    return raw.select(*rest, F.posexplode(one).alias("pos", "raw"))


def is_page(raw: Column) -> Column:
    """A paging wrapper that is no record (B2)."""
    has = lambda n: F.get_json_object(raw, f"$.{n}").isNotNull()
    return has("pageInfo") & (has("content") | has("results"))


def route(raw: Column, types: list[RecordType]) -> Column:
    """Name of the first record type whose condition holds; null if none does."""
    out = F.lit(None).cast("string")
    for t in reversed(types):
        hold = F.lit(True) if t.condition in (None, "always") else J.condition(raw, t.condition)
        out = F.when(hold, F.lit(t.name)).otherwise(out)
    return out


def source_id(raw: Column, id_field: str | None = None) -> Column:
    """A record's own id: the configured field, usual names, the first key that ends like an id, a link."""
    text = lambda n: F.nullif(J.value(raw, n), F.lit(""))
    keys = F.filter(F.json_object_keys(raw), lambda k: k.rlike("(_id|Id)$"))
    by_key = F.try_element_at(F.from_json(raw, "map<string,string>"), F.try_element_at(keys, F.lit(1)))
    own = [text(id_field)] if id_field else []
    return F.coalesce(*own, *[text(n) for n in ID_FIELDS], F.nullif(by_key, F.lit("")), *[text(n) for n in LINK_FIELDS])


def field(raw: Column, mapping) -> Column:
    """A column of one mapping: path, paths, template, processor, expression, helper, or a bare path (B4-B9, H27, L2); no mapping can hold code."""
    if isinstance(mapping, str):
        return J.value(raw, mapping)
    kind = mapping.get("type", "path")
    if kind == "path":
        return J.value(raw, mapping["path"])
    if kind == "paths":
        return J.paths(raw, mapping["paths"], mapping.get("separator", " "))
    if kind == "template":
        return J.template(raw, mapping["template"])
    if kind == "processor":
        return PROCESSORS[mapping["processor"]](J.value(raw, mapping["path"]))
    if kind == "expression":
        return J.search(raw, mapping["expression"])
    if kind == "helper":
        return HELPERS[mapping["helper"]](raw, mapping)
    raise ValueError(f"unknown mapping {kind!r}")


def _plain_text(rich: Column) -> Column:
    """The texts of rich-text blocks (JSON), one after another, without marks."""
    blocks = F.from_json(rich, RICH)
    return F.coalesce(F.array_join(F.transform(blocks, lambda b: F.coalesce(F.nullif(b["text"]["content"], F.lit("")), b["plain_text"], F.lit(""))), ""), F.lit(""))


#: What mappings may call by name (L2): of the record's JSON and the mapping.
HELPERS = {
    "jsonPath": lambda raw, m: J.value(raw, m["path"]),
    "extractRichText": lambda raw, m: _plain_text(J.value(raw, m["path"])),
    "formatDate": lambda raw, m: parse_date(J.value(raw, m["path"])).cast("string"),
    "generateId": lambda raw, m: record_id(F.lit(m["source"]), F.lit(m["record_type"]), J.value(raw, m["path"])),
}


def as_list(raw: Column, mapping) -> Column:
    """A mapping's value as an array; a scalar is wrapped (B1)."""
    path = mapping if isinstance(mapping, str) else mapping.get("path", "")
    if path:
        got = J.value(raw, path)
        listed = F.from_json(F.when(got.rlike(r"^\s*\["), got), "array<string>")
        return F.coalesce(listed, F.when(truthy(got), F.array(got)), F.array().cast("array<string>"))
    return F.array(field(raw, mapping))


def transform(raw: DataFrame, config: SyncConfig) -> DataFrame:
    """Unified records of raw rows (ord, raw): wrappers and rows without a type or an id are left out."""
    rows = raw.where(~F.coalesce(is_page(F.col("raw")), F.lit(False))).withColumn("record_type", route(F.col("raw"), config.record_types)).where(F.col("record_type").isNotNull())
    out = None
    for t in config.record_types:
        r, f = F.col("raw"), t.fields
        get = lambda n, r=r, f=f: field(r, f[n]) if n in f else F.lit(None).cast("string")
        many = lambda n, r=r, f=f: as_list(r, f[n]) if n in f else F.array().cast("array<string>")
        part = (
            rows.where(F.col("record_type") == t.name)
            .withColumn("source_id", source_id(r, t.id_field))
            .where(F.col("source_id").isNotNull())
            .select(
                "ord",
                record_id(F.lit(config.source), F.col("record_type"), F.col("source_id")).alias("_id"),
                F.lit(config.source).alias("source"),
                "source_id",
                "record_type",
                F.coalesce(F.nullif(get("title"), F.lit("")), F.lit("Untitled")).alias("title"),
                F.coalesce(get("content"), F.lit("")).alias("content"),
                many("people").alias("people"),
                many("tags").alias("tags"),
                coerce(get("created_at")).alias("source_created_at"),
                coerce(get("updated_at")).alias("source_updated_at"),
                F.col("raw").alias("raw_data"),
            )
        )
        out = part if out is None else out.unionByName(part)
    return out.withColumn("checksum", content_checksum(F.col("title"), F.col("content")))


def quarantine(raw: DataFrame, config: SyncConfig) -> DataFrame:
    """Raw rows that transform leaves out, with the reason."""
    r = F.col("raw")
    reason = (
        F.when(F.coalesce(is_page(r), F.lit(False)), "page_wrapper").when(route(r, config.record_types).isNull(), "no_record_type").when(source_id(r).isNull() & F.lit(all(not t.id_field for t in config.record_types)), "no_id")
    )
    return raw.withColumn("reason", reason).where(F.col("reason").isNotNull())


def extract_entities(records: DataFrame, source: str, kind: str, id_path: str, title_path: str | None = None, condition: str | None = None) -> DataFrame:
    """Entities of records by a path, one or many a record (B19): record, id, type, title."""
    raw = F.col("raw_data")
    rows = records.where(J.condition(raw, condition)) if condition else records
    ids = J.values(raw, id_path)
    titles = J.values(raw, title_path) if title_path else ids
    zipped = rows.select("_id", F.explode(F.arrays_zip(ids.alias("i"), titles.alias("t"))).alias("x")).where(truthy(F.col("x.i")))
    return zipped.select("_id", config_entity_id(F.lit(source), F.lit(kind), F.col("x.i")).alias("id"), F.lit(kind).alias("type"), F.coalesce("x.t", "x.i").alias("title"))


def extract_relationships(records: DataFrame, source: str, kind: str, target_kind: str, id_path: str, condition: str | None = None, confidence: float = 1.0) -> DataFrame:
    """Edges from records to what a path names."""
    raw = F.col("raw_data")
    rows = records.where(J.condition(raw, condition)) if condition else records
    found = rows.select("_id", F.explode(J.values(raw, id_path)).alias("v")).where(truthy(F.col("v")))
    return found.select(F.col("_id").alias("src"), F.lit(kind).alias("type"), config_entity_id(F.lit(source), F.lit(target_kind), F.col("v")).alias("dst"), F.lit(confidence).alias("confidence"))


def enrich(records: DataFrame, lookup: DataFrame, key: str, name: str) -> DataFrame:
    """Add a lookup's row, or null, under a name (A12); ``lookup`` has the key once."""
    return records.join(lookup.select(key, F.struct(*[c for c in lookup.columns if c != key]).alias(name)), key, "left")


def aggregate_children(parents: DataFrame, children: DataFrame, key: str, name: str, required: bool = False) -> DataFrame:
    """Add each parent's children as an array in order (A13); ``children`` have ord."""
    listed = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", *[c for c in children.columns if c not in (key, "ord")]))).alias(name))
    return parents.join(listed, key, "inner" if required else "left")
