"""The table of unified records: lookups, change detection, upserts and statistics."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.ids import content_checksum


def live(records: DataFrame) -> DataFrame:
    """Without soft-deleted rows."""
    return records.where(F.col("deleted_at").isNull())


def by_ids(records: DataFrame, ids: DataFrame) -> DataFrame:
    return live(records).join(ids.select("_id").distinct(), "_id", "left_semi")


def by_source(records: DataFrame, source: str, record_type: str | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Live records of a source and type, a page of them in id order."""
    rows = live(records).where(F.col("source") == source)
    if record_type is not None:
        rows = rows.where(F.col("record_type") == record_type)
    if skip or limit is not None:
        rows = rows.orderBy("_id").offset(skip)
        rows = rows.limit(limit) if limit is not None else rows
    return rows


def needs_graph_index(records: DataFrame) -> DataFrame:
    """Live records never put in the graph, or changed since."""
    return live(records).where(F.col("last_graph_index_at").isNull() | ~F.col("checksum").eqNullSafe(F.col("last_graph_index_checksum")))


def needs_embedding(records: DataFrame) -> DataFrame:
    """Live records never embedded, or updated since."""
    return live(records).where(F.col("last_embedded_at").isNull() | (F.col("source_updated_at") > F.col("last_embedded_at")))


def needs_reembedding(metadata: DataFrame) -> DataFrame:
    """Metadata whose content is not what was embedded."""
    return metadata.where(~F.col("embedded_checksum").eqNullSafe(F.col("content_checksum")) | F.col("embedded_checksum").isNull())


def changes(new: DataFrame, old: DataFrame, with_deleted: bool = False) -> DataFrame:
    """Each id's state: new, changed or unchanged, and deleted if asked for (G6); both have _id and checksum."""
    n = new.select("_id", F.col("checksum").alias("n"))
    o = old.select("_id", F.col("checksum").alias("o"))
    both = n.join(o, "_id", "full_outer" if with_deleted else "left")
    state = F.when(F.col("n").isNull(), "deleted").when(F.col("o").isNull() | (F.col("o") == ""), "new").when(F.col("n") != F.col("o"), "changed").otherwise("unchanged")
    return both.select("_id", state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, lifecycle: list[str] | None = None) -> DataFrame:
    """Records of both by _id (A16, A17): new fields win, the checksum is recomputed, the version rises by one.

    Columns in ``lifecycle`` keep the old value. Of repeated new rows of an _id the latest by synced_at counts, nulls
    first; equal times are ordered by all other columns, so which row wins never depends on the order of rows.
    """
    keep = set(lifecycle or []) | {"version"}
    rest = [c for c in new.columns if c not in ("_id", "synced_at")]
    newest = new.groupBy("_id").agg(F.max(F.struct("synced_at", *rest)).alias("n"))
    both = old.select("_id", F.struct(*old.columns).alias("o")).join(newest, "_id", "full_outer")
    cols = []
    for c in old.columns:
        if c == "_id":
            cols.append(F.col("_id"))
        elif c == "version":
            cols.append((F.coalesce("o.version", F.lit(0)) + F.when(F.col("n").isNotNull(), 1).otherwise(0)).cast(old.schema["version"].dataType).alias(c))
        elif c in keep or c not in new.columns:
            cols.append(F.col(f"o.{c}").alias(c))
        elif c == "checksum":
            cols.append(F.when(F.col("n").isNull(), F.col("o.checksum")).otherwise(content_checksum(F.col("n.title"), F.col("n.content"))).alias(c))
        else:
            cols.append(F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*cols)


def records_by_type(records: DataFrame) -> DataFrame:
    """Live records of each type."""
    return live(records).groupBy("record_type").agg(F.count("*").alias("n"))


def records_by_source(records: DataFrame) -> DataFrame:
    """Records of each source, how many are embedded or in the graph, and the last sync (D3)."""
    return records.groupBy("source").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("last_embedded_at").isNotNull()).alias("embedded"),
        F.count_if(F.col("last_graph_index_at").isNotNull()).alias("graph_indexed"),
        F.max("synced_at").alias("last_sync"),
    )


def overview(records: DataFrame, now: datetime.datetime) -> DataFrame:
    """One row of totals."""
    return records.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("deleted_at").isNull()).alias("live"),
        F.count_if(F.col("deleted_at").isNotNull()).alias("deleted"),
        F.count_if(F.col("last_embedded_at").isNotNull()).alias("embedded"),
        F.count_if(F.col("source_updated_at") >= F.lit(now - datetime.timedelta(days=1))).alias("updated_last_day"),
        F.countDistinct("source").alias("sources"),
    )


def mention_statistics(metadata: DataFrame) -> DataFrame:
    """Totals over metadata with an array ``mentions``."""
    n = F.coalesce(F.size("mentions"), F.lit(0))
    n = F.greatest(n, F.lit(0))
    return metadata.agg(F.count("*").alias("total"), F.count_if(n > 0).alias("with_mentions"), F.count_if(n == 0).alias("orphans"), F.avg(n).alias("mean_mentions"))


def cutoff(records: DataFrame, date: Column, since: datetime.datetime) -> DataFrame:
    """Records dated at or after a cutoff; undated ones stay."""
    return records.where(date.isNull() | (date >= F.lit(since)))


def activity(states: DataFrame, records: DataFrame, minutes: int = 5, limit: int = 10) -> DataFrame:
    """The last sync runs with the records synced within some minutes of each.

    ``states``: source, synced_at. A range join: minutes are bucketed, so it is an equi-join.
    """
    width = minutes * 60
    last = states.orderBy(F.desc("synced_at"), "source").limit(limit)
    s = last.withColumn("_t", F.unix_seconds("synced_at")).withColumn("_b", F.explode(F.expr(f"sequence(floor((_t - {width}) / {width}), floor((_t + {width}) / {width}))")))
    r = records.select(F.col("source").alias("_src"), F.unix_seconds("synced_at").alias("_rt")).withColumn("_rb", F.floor(F.col("_rt") / width))
    near = s.join(r, (F.col("_b") == F.col("_rb")) & (F.col("source") == F.col("_src")) & (F.abs(F.col("_t") - F.col("_rt")) <= width), "left")
    return near.groupBy("source", "synced_at").agg(F.count("_rt").alias("n"))


def newest(rows: DataFrame, date: str, key: str, n: int = 1) -> DataFrame:
    """The last rows by a date, ties by key: the newest synced record, the last sync states, a capped history."""
    return rows.orderBy(F.desc_nulls_last(date), key).limit(n)
