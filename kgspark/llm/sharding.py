"""Sharding by sampled splitters: shards of near-equal bytes that are ranges of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm._shared import first_bound, materialize

SHARDS = 16
#: Fine ranges of each shard; an overfull one is subdivided, so a shard's bytes are off by about one part in so many.
#: A range, which one task numbers, has about RANGE_BYTES, as long as there are no more than MOST_RANGES of a shard.
RANGES_PER_SHARD, MOST_RANGES, RANGE_BYTES = 128, 4096, 256 << 20
#: Expected number of sampled keys for each range.
SAMPLE = 20


def range_shards(rows: DataFrame, shards: int = SHARDS, per_shard: int | None = None, sample: int | None = None) -> DataFrame:
    """Add shard (0 to ``shards`` - 1) and slot (gapless from 0 in its shard) to ``rows`` (id, key long, size long, others).

    ``serial`` (long), if ``rows`` have it, tells repeated rows of one id apart, so that they can be split too.

    A row is drawn for the sample with probability in proportion to its size; quantiles of the drawn keys split the
    keys into fine ranges. Rows of one key stay in one range, unless they alone are larger than a fine range
    should be: such a key (there can be at most as many as ranges) is subdivided by id and serial. Other ranges that hold
    over twice their share are subdivided by a second hash of the key. Runs of ranges, by their exact bytes, are
    the shards. Only tables with a row per range are broadcast or sorted in one task.
    Sizes must be at least 1. An empty table gives no rows.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    per_shard = per_shard or min(MOST_RANGES, max(RANGES_PER_SHARD, -(-total // (shards * RANGE_BYTES))))
    ranges = shards * per_shard
    sample = sample or SAMPLE * ranges
    own = ["id", "serial"] if "serial" in rows.columns else ["id"]
    share = max(1.0, total / ranges)
    draw = F.pmod(F.xxhash64(*own, "key", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(draw < F.col("size") * (sample / max(total, 1)))
    cuts = drawn.agg(F.percentile_approx("key", [k / ranges for k in range(1, ranges)], max(20_000, 4 * ranges))).first()[0] or []
    heavy = F.broadcast(rows.groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > share).select("key", F.ceil(F.col("bytes") / share).alias("parts")))
    keyed = rows.join(heavy, "key", "left").withColumn("range", first_bound(F.col("key"), sorted(set(cuts))).cast("long"))
    sizes = keyed.where("parts is null").groupBy("range").agg(F.sum("size").alias("bytes"))
    over = F.broadcast(sizes.where(F.col("bytes") > 2 * share).select("range", F.ceil(F.col("bytes") / share).alias("pieces")))
    split = keyed.join(over, "range", "left")
    unit = F.struct(
        F.col("range"),
        F.when(F.col("parts").isNotNull(), F.col("key")).alias("heavy"),
        F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(*own), F.col("parts"))).when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("key", F.lit("piece")), F.col("pieces"))).otherwise(0).alias("part"),
    )
    split = split.select(*rows.columns, unit.alias("unit"))
    units = split.groupBy("unit").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = F.sum("bytes").over(Window.orderBy("unit")) - F.col("bytes")
    shard = F.least(F.floor((before + F.col("bytes") / 2) * shards / max(total, 1)), F.lit(shards - 1)).cast("int")
    units = units.withColumn("shard", shard)
    units = units.withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("unit")) - F.col("n")).select("unit", "shard", "first")
    placed = split.join(F.broadcast(units), "unit")
    slot = F.col("first") + F.row_number().over(Window.partitionBy("unit").orderBy("key", *own)) - 1
    return placed.select(*rows.columns, "shard", slot.alias("slot"))


def op4_sampled_splitters(spark, sf_dir: str) -> DataFrame:
    """Law ``bytes``: shards of near-equal size; equal texts have equal keys and so lie together. Null texts are empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = materialize(
        docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("key"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("serial"))
    )
    return range_shards(rows).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
