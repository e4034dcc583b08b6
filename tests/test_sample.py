"""Samples are drawn by hashes: only the rows of one step of the hash are put in order (F16)."""

from math import ceil

from pyspark.sql import functions as F

from kgspark.operators import order as O


def test_only_one_step_is_ordered(spark, monkeypatch):
    moved = []
    index = O.order_index
    monkeypatch.setattr(O, "order_index", lambda rows, order, *a: (moved.append(rows.count()), index(rows, order, *a))[1])
    monkeypatch.setattr(O, "STEPS", 64, raising=False)
    rows = spark.range(5000).select("id", (F.col("id") % 2).alias("s"))
    drawn = {r.id for r in O.sample(rows, ["id"], 0.1, 3).collect()}
    assert len(drawn) == 500 and sum(moved) < 5000 / 64 * 2
    assert 200 < sum(i % 2 for i in drawn) < 300 and drawn != {r.id for r in O.sample(rows, ["id"], 0.1, 4).collect()}
    want = sorted((r.h, r.id) for r in rows.select("id", F.xxhash64(F.lit(3), "id").alias("h")).collect())
    # Steps are in unsigned order.
    assert drawn == {i for _, i in sorted((h % 2**64, i) for h, i in want)[:500]}


def test_sizes_are_exact(spark):
    for n, share in ((0, 0.5), (1, 0.1), (7, 0.0), (7, 1.0), (10, 0.3)):
        got = [r.id for r in O.sample(spark.range(n), ["id"], share, 1).collect()]
        assert len(got) == len(set(got)) == ceil(share * n)
    equal = spark.range(100).select(F.lit(1).alias("k"))
    assert O.sample(equal, ["k"], 0.25, 1).count() == 25
