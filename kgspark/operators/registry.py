"""The registry of graph types: small tables with a version and a capped history."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators.graph import one_of

ENTITY_TYPES = "name string, description string"
RELATIONSHIP_TYPES = "name string, source_types array<string>, target_types array<string>, bidirectional boolean"
HISTORY = "version int, updated_at timestamp, reason string, entity_types_added int, relationship_types_added int, total_entity_types int, total_relationship_types int"
#: Entries of the history that are kept.
KEEP = 20


def new(spark: SparkSession) -> dict[str, DataFrame]:
    """An empty registry."""
    return {"entities": spark.createDataFrame([], ENTITY_TYPES), "relationships": spark.createDataFrame([], RELATIONSHIP_TYPES), "history": spark.createDataFrame([], HISTORY)}


def add(types: DataFrame, found: DataFrame) -> DataFrame:
    """Types with those of ``found`` that are new by name (G5); of equal names the least row, whatever the order of rows."""
    fresh = found.join(types.select("name"), "name", "left_anti").select(*types.columns)
    return types.unionByName(one_of(fresh, "name", last=False))


def update(registry: dict[str, DataFrame], entities: DataFrame, relationships: DataFrame, reason: str, at: datetime.datetime) -> dict[str, DataFrame]:
    """The registry with new types, its version raised and the change noted; unchanged if nothing is new."""
    out = {"entities": add(registry["entities"], entities), "relationships": add(registry["relationships"], relationships)}
    # Type registries hold tens of rows: their counts are read on the driver.
    before = [registry[k].count() for k in ("entities", "relationships")]
    after = [out[k].count() for k in ("entities", "relationships")]
    if before == after:
        return registry
    version = (registry["history"].agg(F.max("version")).first()[0] or 1) + 1
    spark = registry["history"].sparkSession
    entry = spark.createDataFrame([(version, at, reason, after[0] - before[0], after[1] - before[1], *after)], HISTORY)
    out["history"] = registry["history"].unionByName(entry).orderBy(F.desc("version")).limit(KEEP)
    return out


def valid_relationships(types: DataFrame, source: str, target: str) -> DataFrame:
    """Relationship types between two entity types; ``*`` stands for any."""
    fits = lambda c, t: F.array_contains(c, t) | F.array_contains(c, "*")
    return types.where(fits("source_types", source) & fits("target_types", target))


def discovered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity and relationship types of a graph, with the types at their ends."""
    e = nodes.select(F.col("label").alias("name")).distinct().withColumn("description", F.lit("discovered"))
    ends = edges.join(nodes.select(F.col("id").alias("src"), F.col("label").alias("s")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("label").alias("d")), "dst")
    r = ends.groupBy(F.col("type").alias("name")).agg(F.array_sort(F.collect_set("s")).alias("source_types"), F.array_sort(F.collect_set("d")).alias("target_types")).withColumn("bidirectional", F.lit(False))
    return e, r
