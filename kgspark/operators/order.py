"""Row numbers, shuffles, samples and deep pages without a sort in one task."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.operators.ranges import RANGE_ROWS
from kgspark.session import shared_folder, written

#: Rounds of the permutation, and walks after which a number outside is an error (it cannot be for up to WALKS numbers in excess).
ROUNDS, WALKS = 6, 64
#: Ranges of an index, at most, as long as they hold no more than RANGE_ROWS rows each: each costs a task and a folder.
RANGES = 512
#: Steps of the hash by which a sample is drawn (a power of two): a row of counts each.
STEPS = 1 << 16


@dataclass
class OrderIndex:
    """A table in ranges of an order, each in its own folder, and how many rows lie before each range."""

    rows: DataFrame
    order: list
    before: list[tuple[int, int, int]]

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` of the order, with their number ``_n``; only the ranges that hold them are read."""
        parts = [(p, b) for p, b, n in self.before if b < offset + limit and b + n > offset]
        if not parts:
            return self.rows.where(F.lit(False)).withColumn("_n", F.lit(0).cast("long")).drop("_part")
        base = F.lit(0).cast("long")
        for p, b in parts:
            base = F.when(F.col("_part") == p, F.lit(b)).otherwise(base)
        some = self.rows.where(F.col("_part").isin([p for p, _ in parts]))
        n = base + F.row_number().over(Window.partitionBy("_part").orderBy(*self.order)) - 1
        return some.withColumn("_n", n.cast("long")).where((F.col("_n") >= offset) & (F.col("_n") < offset + limit)).drop("_part")

    def numbered(self) -> DataFrame:
        """All rows with their number ``_n`` in the order, from 0 without gaps."""
        spark = self.rows.sparkSession
        starts = spark.createDataFrame([(p, b) for p, b, _ in self.before], "_part int, _before long")
        n = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*self.order)) - 1
        return self.rows.join(F.broadcast(starts), "_part").withColumn("_n", n.cast("long")).drop("_part", "_before")


def order_index(rows: DataFrame, order: list, size: int = RANGE_ROWS) -> OrderIndex:
    """Write ``rows`` in ranges of about ``size`` rows, or more where that makes over RANGES of them, of ``order`` (names or columns, which should tell rows apart; equal rows may stand in any order).

    The counts are a row a range; everything else stays distributed. The index is a written copy and does not follow its table.
    """
    spark = rows.sparkSession
    n = rows.count()
    parts = max(1, -(-n // max(size, min(RANGE_ROWS, -(-n // RANGES)))))
    path = f"{shared_folder(spark)}/order-{uuid.uuid4().hex}"
    rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).write.partitionBy("_part").parquet(path)
    if not rows.sparkSession.read.schema("_part int").parquet(path).take(1):
        return OrderIndex(written(rows.withColumn("_part", F.lit(0))), order, [])
    kept = spark.read.schema(rows.withColumn("_part", F.lit(0)).schema).parquet(path)
    before, at = [], 0
    for p, n in sorted(map(tuple, kept.groupBy("_part").agg(F.count("*")).collect())):
        before.append((p, at, n))
        at += n
    return OrderIndex(kept, order, before)


def permuted(number: Column, n: int, seed: int) -> Column:
    """The place of a number from 0 to n - 1 in a permutation of them that ``seed`` decides.

    A Feistel network on two digits, a x b >= n of nearly equal size: each round adds a hash of one digit to the other,
    which can be undone, so no two numbers meet; the few results outside are put through again.
    """
    if n <= 1:
        return F.lit(0).cast("long")
    a = int(n**0.5)
    a += a * a < n
    b = -(-n // a)

    def once(x: Column) -> Column:
        high, low = F.floor(x / b).cast("long"), F.pmod(x, F.lit(b))
        for r in range(0, ROUNDS, 2):
            high = F.pmod(high + F.pmod(F.xxhash64(low, F.lit(seed), F.lit(r)), F.lit(a)), F.lit(a))
            low = F.pmod(low + F.pmod(F.xxhash64(high, F.lit(seed), F.lit(r + 1)), F.lit(b)), F.lit(b))
        return high * b + low

    # Each round names the digits several times: a lambda's argument keeps the expression small.
    let = lambda x, use: F.transform(F.array(x), use)[0]
    # Only the few numbers outside walk on.
    walk = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(min(WALKS, a * b - n + 1))), x, lambda y, _: F.when(y < n, y).otherwise(once(y)))
    lost = F.raise_error(F.lit("the permutation did not come back")).cast("long")
    return let(let(number.cast("long"), once), lambda x: F.when(x < n, x).otherwise(let(walk(x), lambda y: F.when(y < n, y).otherwise(lost))))


def shuffled(rows: DataFrame, order: list, seed: int) -> DataFrame:
    """``rows`` with ``place``, from 0 without gaps in a random order that depends on the rows' order and ``seed`` alone."""
    index = order_index(rows, order)
    n = sum(x[2] for x in index.before)
    return index.numbered().withColumn("place", permuted(F.col("_n"), n, seed)).drop("_n")


def sample(rows: DataFrame, key: list, share: float, seed: int) -> DataFrame:
    """Exactly ``share`` of the rows, rounded up, drawn without replacement; the same for a seed however rows are partitioned.

    Those with the smallest hashes of ``key`` (names or columns, which should tell rows apart; rows equal in it are drawn
    together, but for the last ones). Counts of STEPS steps of the hash tell the step that holds the last row drawn; only
    that step's rows are put in order, so no other row is moved.
    """
    h = F.xxhash64(F.lit(seed), *key)
    step = F.shiftrightunsigned(h, 64 - STEPS.bit_length() + 1)
    counts = sorted(map(tuple, rows.groupBy(step.alias("step")).count().collect()))
    left = ceil(share * sum(n for _, n in counts))
    last = -1
    for last, n in counts:
        if n >= left:
            break
        left -= n
    edge = order_index(written(rows.where(step == last)).withColumn("_h", h), ["_h", *key]).page(0, left)
    return rows.where(step < last).union(edge.drop("_h", "_n"))
