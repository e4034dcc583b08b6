"""Scans, searches and pages over record tables, and file sources and sinks."""

from __future__ import annotations

import csv
import io
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON data set of one or many lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def csv_objects(raw: Column, delimiter: str = ",", header: bool = True, trim: bool = True, skip_empty: bool = True) -> Column:
    """CSV text as an array of JSON objects by its header line, or of JSON lists without one.

    Quoted values may hold line breaks and delimiters; numbers become numbers; ragged lines are padded or cut.
    """

    @F.pandas_udf("array<string>")
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _csv_lines(t or "", delimiter, header, trim, skip_empty))

    return parse(raw)


_INTEGER, _NUMBER = re.compile(r"-?\d+"), re.compile(r"-?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?")


def _csv_lines(text: str, delimiter: str, header: bool, trim: bool, skip_empty: bool) -> list[str]:
    """The lines of one text; a small helper round the standard reader."""

    def typed(v: str):
        v = v.strip() if trim else v
        return int(v) if _INTEGER.fullmatch(v) else float(v) if _NUMBER.fullmatch(v) else v

    lines = [x for x in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, skipinitialspace=trim) if not skip_empty or any(v.strip() for v in x)]
    if not header:
        return [json.dumps([typed(v) for v in x], ensure_ascii=False) for x in lines]
    names = [n.strip() if trim else n for n in lines[0]] if lines else []
    return [json.dumps({n: typed(v) for n, v in zip(names, x, strict=False)}, ensure_ascii=False) for x in lines[1:]]


def csv_rows(raw: Column, schema: str, delimiter: str = ",") -> Column:
    """CSV text with a header line as an array of structs of a known schema."""
    return F.transform(csv_objects(raw, delimiter), lambda x: F.from_json(x, schema))


def write_csv(df: DataFrame, path: str) -> None:
    """A report with a header."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def keyset_page(rows: DataFrame, key: str, after=None, size: int = 100) -> DataFrame:
    """The rows after a key, in order (A28, A32): pages neither skip nor repeat."""
    rows = rows.where(F.col(key) > after) if after is not None else rows
    return rows.orderBy(key).limit(size)


def offset_page(rows: DataFrame, order: list[Column], page: int = 1, size: int = 30) -> DataFrame:
    """A numbered page in an order."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


_QUALIFIER = re.compile(r"\b(author|state|label):(\"[^\"]+\"|\S+)")


def pull_predicate(query: str, author: str = "author", state: str = "state", labels: str = "labels", title: str = "title", body: str = "body") -> Column:
    """Predicate of a search text (A30): the first qualifier present decides, else title or body holds the text."""
    found = {m[1]: m[2].strip('"') for m in _QUALIFIER.finditer(query)}
    if "author" in found:
        return F.col(author) == found["author"]
    if "state" in found:
        return F.col(state) == found["state"]
    if "label" in found:
        return F.array_contains(F.col(labels), found["label"])
    text = F.lit(query.strip().lower())
    return F.contains(F.lower(F.col(title)), text) | F.contains(F.lower(F.coalesce(F.col(body), F.lit(""))), text)


def search_pulls(pulls: DataFrame, query: str, sort: str = "created", descending: bool = True, page: int = 1, size: int = 30, **columns: str) -> DataFrame:
    """A page of matches and their total."""
    hits = pulls.where(pull_predicate(query, **columns))
    by = F.col("updated_at" if sort == "updated" else "created_at")
    total = hits.agg(F.count("*").alias("total"))
    paged = offset_page(hits, [by.desc() if descending else by.asc(), F.col("id")], page, size)
    return paged.join(F.broadcast(total))


def search_objects(frames: list[DataFrame], text: str, limit: int) -> DataFrame:
    """Objects of several tables whose JSON holds a text (A31): the first ``limit`` in the order of their JSON."""
    out = None
    for f in frames:
        hit = f.withColumn("_json", F.to_json(F.struct(*f.columns))).where(F.contains(F.lower("_json"), F.lit(text.lower())))
        out = hit if out is None else out.unionByName(hit, allowMissingColumns=True)
    return out.orderBy("_json").limit(limit).drop("_json")


def between(rows: DataFrame, date: str, after=None, before=None) -> DataFrame:
    """Rows dated in an inclusive range."""
    rows = rows.where(F.col(date) >= after) if after is not None else rows
    return rows.where(F.col(date) <= before) if before is not None else rows


def latest(rows: DataFrame, by: list[str], date: str) -> DataFrame:
    """The latest row of each key."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in by]), F.struct(date, *[c for c in rows.columns if c not in (*by, date)])).alias("r")).select(*by, "r.*")


def batches(rows: DataFrame, value: str, size: int, order: str) -> DataFrame:
    """Values in slices for batched calls (A7); ``order`` is gapless from 0."""
    return rows.groupBy(F.floor(F.col(order) / size).alias("batch")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("values"))


def for_each(seeds: DataFrame, source: DataFrame, on: str) -> DataFrame:
    """Rows of a source for each seed of earlier ones, once a seed."""
    return source.join(seeds.select(on).distinct(), on, "left_semi")


def judged_queries(spark: SparkSession, path: str, skip: DataFrame | None = None) -> DataFrame:
    """Test cases of an evaluation file: workflow, number, query, must_include."""
    schema = "array<struct<workflow:struct<groupId:string>,testCases:array<struct<query:string,evaluationCriteria:struct<mustInclude:array<string>>>>>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("w"))
    rows = whole.select(F.col("w.workflow.groupId").alias("workflow"), F.posexplode("w.testCases").alias("n", "c")).select("workflow", "n", "c.query", F.col("c.evaluationCriteria.mustInclude").alias("must_include"))
    return rows.join(skip.select("workflow"), "workflow", "left_anti") if skip is not None else rows
