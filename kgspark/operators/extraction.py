"""Extraction of entities and relationships from records by a pluggable model, and the graph indexing pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import sanitize_name, sanitize_relationship_type, strip_quotes
from kgspark.operators import graph as G

RESULT = (
    "record_id string, checksum string, content_length int, entities array<struct<name:string,type:string,description:string>>, "
    "relationships array<struct<source:string,target:string,type:string,description:string,strength:double>>, error string"
)


def dictionary_extractor(names: dict[str, str]) -> Callable[[str], dict]:
    """A stand-in for a language model: known names found in a text, each linked to the next."""

    def extract(text: str) -> dict:
        found = sorted((text.find(n), n) for n in names if n in text)
        ents = [{"name": n, "type": names[n], "description": f"{n} in a record"} for _, n in found]
        rels = [{"source": a, "target": b, "type": "NEXT_TO", "description": "follows", "strength": 7.0} for (_, a), (_, b) in zip(found, found[1:], strict=False)]
        return {"entities": ents, "relationships": rels}

    return extract


def extract(records: DataFrame, extractor: Callable[[str], dict]) -> DataFrame:
    """Extraction results of changed records with content (I8, B27): a row each; a failure becomes ``error``."""
    todo = records.where(F.coalesce(F.trim("content"), F.lit("")) != "").select("_id", "checksum", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, c, text in zip(b["_id"], b["checksum"], b["content"], strict=True):
                try:
                    r = extractor(text)
                    out.append((i, c, len(text), r.get("entities", []), r.get("relationships", []), None))
                except Exception as e:  # the model is outside code: its failure is a status
                    out.append((i, c, len(text), [], [], str(e)[:500]))
            yield pd.DataFrame(out, columns=["record_id", "checksum", "content_length", "entities", "relationships", "error"])

    return todo.mapInPandas(run, RESULT)


def clean(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relationships of results with clean names (I9): names that are none go, and edges without both ends."""
    ents = results.select("record_id", "content_length", F.posexplode("entities").alias("pos", "e")).select(
        "record_id", "content_length", "pos", sanitize_name(F.col("e.name")).alias("name"), strip_quotes(F.col("e.type")).alias("type"), F.coalesce("e.description", F.lit("")).alias("description")
    )
    rels = results.select("record_id", F.posexplode("relationships").alias("pos", "r")).select(
        "record_id", "pos", sanitize_name(F.col("r.source")).alias("source"), sanitize_name(F.col("r.target")).alias("target"), sanitize_relationship_type(F.col("r.type")).alias("type"), "r.description", "r.strength"
    )
    return ents.where("name is not null"), rels.where("source is not null and target is not null and type is not null")


def classify(results: DataFrame) -> DataFrame:
    """Status of each record (I11): failed, toxic, empty or success."""
    n, m = F.size("entities"), F.size("relationships")
    mean = F.aggregate("entities", F.lit(0.0), lambda s, e: s + F.length(e["name"])) / n
    status = F.when(F.col("error").isNotNull(), "failed").when((n >= 50) & (m <= 5) & (mean < 20), "toxic").when(n == 0, "empty").otherwise("success")
    return results.withColumn("status", status)


def index_graph(records: DataFrame, extractor: Callable[[str], dict]) -> dict[str, DataFrame]:
    """Nodes, edges, mentions and statuses of records (I11): one pass over a whole table.

    Returns lazy DataFrames; cache or write ``results`` first if the extractor is costly.
    """
    results = classify(extract(records, extractor))
    ents, rels = clean(results.where("status = 'success'"))
    ents = ents.withColumnsRenamed({"record_id": "doc_ord"})
    rels = rels.withColumn("ord", F.struct("record_id", "pos"))
    nodes, edges = G.build_graph(ents, rels)
    names = nodes.select("id", G.normalize_name(F.col("name")).alias("key"))
    mentions = ents.select(G.normalize_name(F.col("name")).alias("key"), F.col("doc_ord").alias("dst")).join(names, "key").select(F.col("id").alias("src"), F.lit("MENTIONED_IN").alias("type"), "dst").distinct().withColumn("confidence", F.lit(1.0))
    return {"results": results, "nodes": nodes, "edges": edges, "mentions": mentions, "status": results.select("record_id", "checksum", "status")}


def statistics(results: DataFrame, seconds: float) -> DataFrame:
    """Records by status and records a second."""
    return results.groupBy("status").agg(F.count("*").alias("n")).withColumn("per_second", F.col("n") / F.lit(max(seconds, 1e-9)))
