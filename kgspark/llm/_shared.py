"""Tables shared between stages of one operator, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one where none is set and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


#: Rows of an Arrow batch. Texts are long rows: Spark's 10,000 would hold tens of megabytes in each worker and twice in the JVM.
BATCH_ROWS = 2048


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session have at most BATCH_ROWS rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: At most so many vertices are sent to all tasks as hubs; every other vertex has under this share of all edge ends.
HUBS = 100_000


def _told(edges: DataFrame, low: DataFrame, ends: int) -> DataFrame:
    """(b, m) for each of ``edges`` (a, b), with a's ``m`` of ``low`` (a, m, n: edges of a).

    A vertex with more than 1/HUBS of the ``ends`` of all edges is a hub; there can be at most HUBS of them, so they are
    broadcast, and no key of the join has more rows than that share.
    """
    most = max(1000, ends // HUBS)
    hubs = F.broadcast(low.where(F.col("n") > most).select("a", F.col("m").alias("hub")))
    marked = edges.join(hubs, "a", "left")
    far = marked.where("hub is not null").select("b", F.col("hub").alias("m"))
    return far.union(marked.where("hub is null").select("a", "b").join(low.where(F.col("n") <= most), "a").select("b", "m"))


def connected_components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Columns (id, component): the smallest id reachable over ``edges`` (a, b), for every id that has an edge.

    Alternates large-star and small-star steps, whose rounds grow with the logarithm of the longest path.
    No vertex gathers its neighbours as a list; only minima are aggregated, and hubs are kept out of the joins. Rounds
    go on until nothing changes; more than ``max_rounds``, if given, are an error.
    """
    spark = edges.sparkSession
    shared_dir(spark)

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    cur = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    before = state(cur)
    rounds = 0
    while before[0]:
        if rounds == max_rounds:
            raise RuntimeError(f"components have not converged after {max_rounds} rounds")
        rounds += 1
        sym = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = _told(sym.where("b > a"), low, 2 * before[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _told(large, low, before[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        cur = small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
        after = state(cur)
        if after == before:
            break
        before = after
    return cur.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).union(cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def first_bound(value, bounds: list[int]):
    """Index of the first of sorted ``bounds`` at or above ``value``, or their number; a binary search in the plan."""
    if not bounds:
        return F.lit(0)
    # A folded literal: one array object, not a tree of literals.
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = len(bounds).bit_length() + 1
    half = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")

    def step(s, _):
        below = (s["lo"] < s["hi"]) & (F.element_at(table, F.least(half(s), F.lit(len(bounds) - 1)) + 1) < value)
        return F.struct(F.when(below, half(s) + 1).otherwise(s["lo"]).alias("lo"), F.when(below | (s["lo"] >= s["hi"]), s["hi"]).otherwise(half(s)).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), step)["lo"]
