"""Streams run to the end over files; their results equal the batch ones."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kgspark.plans.registry import query
from kgspark.plans.tables import read
from kgspark.session import shared_folder
from kgspark.streaming import groups as G
from kgspark.streaming import incremental as I


def _folder(spark) -> str:
    """A fresh folder that driver and executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("SELECT user_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start_s, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly_counts(spark, sf_dir):
    """Hourly counts of a stream, upserted by key as batches arrive."""
    schema = read(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    counts = I.stream_counts(rows.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id")
    out = _folder(spark)

    def handle(batch, n):
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/b{n}")

    q = counts.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").schema("start timestamp, user_id long, n long, batch int").parquet(*[f"{out}/b{i}" for i in range(_batches(q))])
    return found.groupBy("user_id", F.unix_seconds("start").alias("start_s")).agg(F.max_by("n", "batch").alias("n"))


def _batches(q) -> int:
    return q.lastProgress["batchId"] + 1 if q.lastProgress else 1


@query("SELECT fetcher, max(mark) AS mark FROM (SELECT 'orders' AS fetcher, max(o_orderkey) AS mark FROM orders UNION ALL SELECT 'events', 5) GROUP BY 1")
def sync_state(spark, sf_dir):
    state = spark.createDataFrame([("orders", 10), ("events", 5)], "fetcher string, mark long")
    new = I.since(read(spark, sf_dir, "orders"), state, "orders", "o_orderkey")
    return I.advance(state, new, "orders", "o_orderkey")


def _arriving(spark, sf_dir, columns: list[str], key: str, group, slices: int = 3):
    """What ``group`` makes of the events' stream, which stops and goes on from its checkpoint after each slice of time.

    The last slice ends with a row of user -1, late enough for the watermark to pass all others.
    """
    folder = _folder(spark)
    e = read(spark, sf_dir, "events").select(*columns, F.col("ts").cast("timestamp").alias("ts"))
    low, high = e.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    at = F.least(F.floor((F.unix_seconds("ts") - low) * slices / (high - low + 1)), F.lit(slices - 1))
    end = spark.range(1).select(*[F.lit(-1 if c.endswith("_id") else None).cast(e.schema[c].dataType).alias(c) for c in columns], F.timestamp_seconds(F.lit(high + 10 * 86400)).alias("ts"))
    for k in range(slices):
        part = e.where(at == k)
        (part if k < slices - 1 else part.union(end)).write.mode("append").parquet(f"{folder}/in")
        stream = group(spark.readStream.schema(e.schema).parquet(f"{folder}/in"))
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").where(f"{key} >= 0")


@query(
    """WITH e AS (SELECT *, epoch(ts) AS s, lag(epoch(ts)) OVER w AS p, lag(event_type) OVER w AS c FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR s - p > 86400 OR event_type IS DISTINCT FROM c THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e)
SELECT user_id, round(min(s), 3) AS start, count(*) AS n FROM g GROUP BY user_id, session"""
)
def stream_sessions(spark, sf_dir):
    """Sessions with context of arriving events (K9, E3), with a watermark of ten minutes."""
    group = lambda e: G.stream_groups(e, "user_id", "ts", "event_id", 86400, F.col("event_type"), anchored=False)
    rows = _arriving(spark, sf_dir, ["user_id", "event_id", "event_type"], "user_id", group)
    return rows.groupBy("user_id", F.round("group_start", 3).alias("start")).agg(F.count("*").alias("n"))


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id % 16 AS page, event_type, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT *, s AS st FROM e WHERE n = 1 UNION ALL
  SELECT e.*, CASE WHEN e.s - f.st > 3600 OR e.event_type IS DISTINCT FROM f.event_type THEN e.s ELSE f.st END FROM f JOIN e ON e.page = f.page AND e.n = f.n + 1)
SELECT event_id, page, round(st, 3) AS group_start FROM f"""
)
def stream_time_windows(spark, sf_dir):
    """Windows of arriving events, anchored at their first (K9, E2), carried from one micro-batch to the next."""
    group = lambda e: G.stream_groups(e.withColumn("page", F.when(F.col("user_id") < 0, F.lit(-1)).otherwise(F.col("user_id") % 16)), "page", "ts", "event_id", 3600, F.col("event_type"))
    rows = _arriving(spark, sf_dir, ["user_id", "event_id", "event_type"], "page", group)
    return rows.select("event_id", "page", F.round("group_start", 3).alias("group_start"))
