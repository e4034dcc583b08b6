"""What a source holds: seeds, ids in its answers, arrays, match rates of a configuration."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from kgspark.functions import json as J
from kgspark.sources.config import SyncConfig, ordered_fetchers, types_of
from kgspark.sources.paged import call_each
from kgspark.sources.transform import route, source_id

_FOUND = ArrayType(StructType([StructField("path", StringType()), StructField("field", StringType()), StructField("value", StringType())]))


def ids_in(raw: str | None, depth: int = 5, items: int = 5) -> list[dict]:
    """Id-like fields of JSON with their paths, to a depth and the first items of lists."""
    found: list[dict] = []

    def walk(v, path: str, left: int) -> None:
        if left <= 0:
            return
        if isinstance(v, dict):
            for k, x in v.items():
                full = f"{path}.{k}" if path else k
                if "id" in k.lower() and isinstance(x, (str, int, float)) and not isinstance(x, bool) and x != "":
                    found.append({"path": full, "field": k, "value": str(x)})
                if isinstance(x, (dict, list)):
                    walk(x, full, left - 1)
        elif isinstance(v, list):
            for i, x in enumerate(v[:items]):
                walk(x, f"{path}[{i}]", left - 1)

    try:
        walk(json.loads(raw or "null"), "", depth)
    except ValueError:
        return []
    return found


@F.pandas_udf(_FOUND)
def discover_ids(raw: pd.Series) -> pd.Series:
    return raw.map(ids_in)


def array_paths(raw: str, depth: int = 3) -> list[str]:
    """Paths of lists of objects in a sample answer."""
    out: list[str] = []

    def walk(v, path: str, left: int) -> None:
        if isinstance(v, list) and v and isinstance(v[0], dict):
            out.append(path or "$")
        if isinstance(v, dict) and left:
            for k, x in v.items():
                walk(x, f"{path}.{k}" if path else k, left - 1)

    walk(json.loads(raw), "", depth)
    return out


@F.pandas_udf(ArrayType(StringType()))
def array_paths_of(raw: pd.Series) -> pd.Series:
    return raw.map(array_paths)


def seeds(given: list[str] | None, found: DataFrame | None = None, path: str = "id", condition: str | None = None, required: bool = True) -> DataFrame | list[str]:
    """Starting values: those given, or those a discovery answer holds under a path."""
    if given:
        return given
    if found is not None:
        rows = found.where(J.condition(F.col("raw"), condition)) if condition else found
        return rows.select(F.explode(J.values(F.col("raw"), path)).alias("seed")).distinct()
    if required:
        raise ValueError("a starting point is required")
    return []


def coerce_params(params: dict, kinds: dict[str, str]) -> dict:
    """A call's parameters as the types its schema names (A10)."""
    out = dict(params)
    for k, v in params.items():
        kind = kinds.get(k)
        if v is None or kind is None:
            continue
        if kind == "string" and not isinstance(v, str):
            out[k] = str(v).lower() if isinstance(v, bool) else str(v)
        elif kind in ("number", "integer") and isinstance(v, str):
            try:
                out[k] = float(v) if "." in v or "e" in v.lower() else int(v)
            except ValueError:
                pass
        elif kind == "boolean" and isinstance(v, str):
            out[k] = v == "true"
    return out


def dry_run(raw: DataFrame, config: SyncConfig) -> DataFrame:
    """Rows, and how many of them each record type takes and finds an id in."""
    typed = raw.withColumn("record_type", route(F.col("raw"), config.record_types))
    own: Column = F.lit(None).cast("string")
    for t in config.record_types:
        own = F.when(F.col("record_type") == t.name, source_id(F.col("raw"), t.id_field)).otherwise(own)
    return typed.withColumn("own", own).groupBy("record_type").agg(F.count("*").alias("n"), F.count("own").alias("with_id"))


#: Unmatched rows of a page that are reported one by one.
REPORTED = 3


def first_pages(config: SyncConfig, spark, params: dict[str, dict], client: str, **options) -> DataFrame:
    """The first page of each fetcher that is no write or search tool (J1): fetcher, ord, raw, error; a failing call is a row."""
    named = [f for f in ordered_fetchers(config) if f.tool_class == "read"]
    items = spark.createDataFrame([(f.name, json.dumps(params.get(f.name, {}))) for f in named], "fetcher string, params string")
    return call_each(items, "params", client, first_only=True, **options).select("fetcher", "ord", "raw", "error")


def dry_run_report(pages: DataFrame, config: SyncConfig) -> tuple[DataFrame, DataFrame]:
    """What a first page of each fetcher shows (J1): (fetcher, total, matched), and faults (code, fetcher, subject, sample).

    ``pages``: fetcher, ord, raw, error. Codes: NO_MATCHING_RECORD_TYPE, DETECTION_CONDITION_FAILED (of the first rows
    of a page), EMPTY_RESULTS, MCP_TOOL_ERROR, MISSING_FETCHER and ORPHAN_RECORD_TYPE.
    """
    spark = pages.sparkSession
    names = {f.name for f in config.fetchers}
    matched = F.lit(None).cast("string")
    for f in config.fetchers:
        if own := types_of(config, f):
            matched = F.when(F.col("fetcher") == f.name, route(F.col("raw"), own)).otherwise(matched)
    typed = [f.name for f in config.fetchers if types_of(config, f)]
    rows = pages.where(F.col("fetcher").isin(typed) & F.col("error").isNull()).withColumn("record_type", matched)
    stats = rows.groupBy("fetcher").agg(F.count("*").alias("total"), F.count("record_type").alias("matched"))
    fault = lambda df, code, subject, sample: df.select(F.lit(code).alias("code"), "fetcher", subject.cast("string").alias("subject"), sample.cast("string").alias("sample"))
    none = F.lit(None).cast("string")
    found = fault(pages.where(F.col("error").isNotNull()), "MCP_TOOL_ERROR", F.col("error"), none)
    found = found.union(fault(rows.where(F.col("record_type").isNull() & (F.col("ord") < REPORTED)), "DETECTION_CONDITION_FAILED", F.col("ord"), F.substring("raw", 1, 200)))
    found = found.union(fault(stats.where("total > 0 and matched = 0"), "EMPTY_RESULTS", F.col("total"), none))
    plain = [("NO_MATCHING_RECORD_TYPE", f.name, f.tool, None) for f in config.fetchers if f.tool_class == "read" and not types_of(config, f)]
    plain += [(code, r.fetcher, r.name, None) for r in config.record_types if r.fetcher is not None and r.fetcher not in names for code in ("ORPHAN_RECORD_TYPE", "MISSING_FETCHER")]
    return stats, found.union(spark.createDataFrame(plain, found.schema))


def deep_merge(target, source):
    """Objects merged key by key, lists joined, else the source."""
    if not (isinstance(target, dict) and isinstance(source, dict)):
        return source
    out = dict(target)
    for k, v in source.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = deep_merge(out[k], v)
        elif isinstance(v, list) and isinstance(out.get(k), list):
            out[k] = out[k] + v
        else:
            out[k] = v
    return out


@F.pandas_udf(StringType())
def merge_json(target: pd.Series, source: pd.Series) -> pd.Series:
    """JSON objects of two columns merged; a null side leaves the other."""
    one = lambda a, b: b if a is None else a if b is None else json.dumps(deep_merge(json.loads(a), json.loads(b)), ensure_ascii=False)
    return pd.Series([one(a, b) for a, b in zip(target, source, strict=True)])


#: Fields that change without the content changing; fixed values.
VOLATILE = {"last_edited_time", "created_time", "indexed_at", "synced_at", "updated_at", "timestamp"}


def canonical(v):
    """Keys and lists sorted, volatile fields left out."""
    if isinstance(v, dict):
        return {k: canonical(v[k]) for k in sorted(v) if k not in VOLATILE}
    if isinstance(v, list):
        return sorted((canonical(x) for x in v), key=lambda x: json.dumps(x, ensure_ascii=False))
    return v


@F.pandas_udf(StringType())
def canonical_json(raw: pd.Series) -> pd.Series:
    """JSON text in canonical form; hash it for a checksum that ignores order and volatile fields."""
    return raw.map(lambda x: None if x is None else json.dumps(canonical(json.loads(x)), ensure_ascii=False, separators=(",", ":")))
