"""Incremental syncs and streams: batch definitions are the meaning, streams agree with them on closed data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kgspark.operators.records import upsert


def since(rows: DataFrame, state: DataFrame, fetcher: str, date: str) -> DataFrame:
    """Rows after a fetcher's high-water mark (K3); all of them at first. ``state``: fetcher, mark (few rows)."""
    mark = state.where(F.col("fetcher") == fetcher).agg(F.max("mark")).first()[0]
    return rows if mark is None else rows.where(F.col(date) > F.lit(mark))


def advance(state: DataFrame, rows: DataFrame, fetcher: str, date: str) -> DataFrame:
    """The state with a fetcher's mark moved to the newest row (K4)."""
    new = rows.agg(F.max(date).alias("mark")).where(F.col("mark").isNotNull()).select(F.lit(fetcher).alias("fetcher"), "mark")
    return state.unionByName(new).groupBy("fetcher").agg(F.max("mark").alias("mark"))


def next_status(failed: bool, errors: int, most: int = 3) -> tuple[str, int]:
    """A sync's status and its consecutive errors after a run (K4)."""
    return ("error" if errors + 1 >= most else "retry", errors + 1) if failed else ("idle", 0)


def micro_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run all that a stream has now, batch by batch, and stop (K1, K7)."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bounded(spark: SparkSession, form: str, schema, path: str, files: int = 1) -> DataFrame:
    """A stream over files that takes no more than some of them into a micro-batch, so that a slow sink holds it back (K2)."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files).load(path)


def flushes(rows: DataFrame, write: Callable[[list[dict]], None], size: int = 100) -> DataFrame:
    """Hand rows to a writer in flushes of at most ``size``, within each partition (K2): a row (partition, flush, n) for each.

    Runs when the result is used; a repeated task flushes its rows again, so the writer must upsert.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, held, done = TaskContext.get(), [], []
        part = context.partitionId() if context else 0
        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= size:
                write(held[:size])
                done.append(size)
                held = held[size:]
        if held:
            write(held)
            done.append(len(held))
        yield pa.record_batch([pa.array([part] * len(done), pa.int32()), pa.array(range(len(done)), pa.int32()), pa.array(done, pa.int32())], ["partition", "flush", "n"])

    return rows.mapInArrow(run, "partition int, flush int, n int")


def drain(rows: DataFrame, key: str, handle: Callable[[DataFrame], None], size: int, done: Callable[[DataFrame], DataFrame]) -> int:
    """Handle what is to do, ``size`` rows at a time in key order, until nothing is left (K6); how many batches that took.

    ``done(rows)`` gives the rows that are still to do, as their store now has them. A batch starts after the last key
    of the one before, so a pass reads each row once; it is kept while it is handled. Rows that were left in place are
    looked at again in a next pass; a pass that takes none away is an error, not an endless loop. Keys are not null.
    """
    batches = 0
    left = None
    while True:
        todo = done(rows).where(F.col(key).isNotNull()).count()
        if not todo:
            return batches
        if left is not None and todo >= left:
            raise RuntimeError(f"{todo} rows stay to do after a whole pass")
        left, after = todo, None
        while True:
            page = done(rows)
            batch = (page if after is None else page.where(F.col(key) > F.lit(after))).orderBy(key).limit(size).cache()
            n, top = batch.agg(F.count(key), F.max(key)).first()
            if not n:
                batch.unpersist()
                break
            handle(batch)
            batch.unpersist()
            batches, after = batches + 1, top


def upsert_into(spark: SparkSession, folder: str, schema, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch handler that upserts into a table of hash buckets of _id, of which only those a batch touches are written.

    Bucket b after batch n lies in folder b=<b>/v=<n>; its latest version is the one to read, by ``table_of``. A batch
    that is run again writes the same versions again from those before it, so a restart does not count twice.
    """
    bucket = F.pmod(F.xxhash64("_id"), F.lit(buckets)).cast("int")

    def handle(batch: DataFrame, n: int) -> None:
        touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets``
        old = table_of(spark, folder, schema, touched, n)
        new = upsert(old, batch).withColumn("b", bucket).withColumn("v", F.lit(n))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("b", "v").parquet(folder)

    return handle


def table_of(spark: SparkSession, folder: str, schema, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
    """The latest version of each bucket of a table, of some buckets, or as it was before a batch."""
    columns = [f.name for f in schema] if not isinstance(schema, str) else spark.createDataFrame([], schema).columns
    try:
        rows = spark.read.schema(spark.createDataFrame([], schema).withColumn("b", F.lit(0)).withColumn("v", F.lit(0)).schema).parquet(folder)
        files = rows.select("b", "v").distinct() if before is None else rows.where(F.col("v") < before).select("b", "v").distinct()
    except AnalysisException:
        return spark.createDataFrame([], schema)
    if buckets is not None:
        files = files.where(F.col("b").isin(buckets))
    last = [(r[0], r[1]) for r in files.groupBy("b").agg(F.max("v")).collect()]
    if not last:
        return spark.createDataFrame([], schema)
    wanted = F.lit(False)
    for b, v in last:
        wanted = wanted | ((F.col("b") == b) & (F.col("v") == v))
    return rows.where(wanted).select(*columns)


def stream_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts in fixed windows of a stream with a watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), F.col(by)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
