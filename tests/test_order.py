"""Permutations, samples, deep pages and ranks in groups against plain Python."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.operators import metrics as M
from kgspark.operators import order as O


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 7, 10, 100, 101, 1023, 4999])
def test_permutation_is_one(spark, n):
    got = [r[0] for r in spark.range(n).orderBy("id").select(O.permuted(F.col("id"), n, 3)).collect()]
    assert sorted(got) == list(range(n))
    if n > 100:
        other = [r[0] for r in spark.range(n).orderBy("id").select(O.permuted(F.col("id"), n, 4)).collect()]
        assert got != other and abs(np.corrcoef(got, range(n))[0, 1]) < 0.3 and abs(np.corrcoef(got, other)[0, 1]) < 0.3


def test_shuffle_and_sample_do_not_depend_on_partitions(spark, monkeypatch):
    rows = [(f"k{i:03}", i) for i in range(317)]
    monkeypatch.setattr(O, "RANGE_ROWS", 50)
    found = []
    for parts in (1, 4, 9):
        df = spark.createDataFrame(rows, "k string, v int").repartition(parts)
        found.append((sorted(map(tuple, O.shuffled(df, ["k"], 5).collect())), sorted(map(tuple, O.sample(df, ["k"], 0.25, 5).collect()))))
    assert found[0] == found[1] == found[2]
    assert sorted(r[2] for r in found[0][0]) == list(range(317)) and len(found[0][1]) == 80
    assert O.sample(spark.createDataFrame([], "k string"), ["k"], 0.5, 1).count() == 0


def test_pages_read_only_their_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(int(v), i) for i, v in enumerate(rng.integers(0, 50, 1000))]
    df = spark.createDataFrame(rows, "v int, i int").repartition(4)
    order = [F.desc("v"), F.col("i")]
    index = O.order_index(df, order, 100)
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert len(index.before) > 6
    for offset, limit in ((0, 5), (437, 60), (990, 50), (1000, 5), (95, 300)):
        page = index.page(offset, limit)
        assert [(r.v, r.i, r._n) for r in page.orderBy("_n").collect()] == [(*r, offset + k) for k, r in enumerate(want[offset : offset + limit])]
        if offset < 1000:
            assert re.search(r"PartitionFilters: \[[^\]]*_part", page._jdf.queryExecution().executedPlan().toString())
            held = [n for _, b, n in index.before if b < offset + limit and b + n > offset]
            assert sum(held) < limit + 2 * max(n for *_, n in index.before)
    assert [(r.v, r.i) for r in index.numbered().orderBy("_n").collect()] == want


@pytest.mark.parametrize("few", [5, 40, 10_000])
def test_ranks_of_groups(spark, few):
    rng = np.random.default_rng(few)
    groups = {"a": rng.normal(0, 1, 900), "b": np.full(300, 2.5), "c": rng.integers(0, 4, 500).astype(float), "d": np.array([1.0]), None: rng.exponential(1, 200)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in M.summary(df, "v", ["g"], most=few).collect()}
    assert set(got) == {*groups, "e"}
    for g, xs in groups.items():
        s = sorted(xs.tolist())
        n = len(s)
        assert (got[g].p95, got[g].p99, got[g].n) == (s[-(-n * 95 // 100) - 1], s[-(-n * 99 // 100) - 1], n)
        assert got[g]["median"] == pytest.approx((s[(n + 1) // 2 - 1] + s[n // 2]) / 2)
    assert got["e"].p95 is None and got["e"].n == 0


def test_ranks_where_sketches_are_wrong(spark, monkeypatch):
    """Counts, not sketches, decide: however bad the cuts are, the ranks come out exact."""
    rows = [(0, float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, v double")
    monkeypatch.setattr(M.F, "approx_percentile", lambda c, ps, acc: F.array(*[F.min(c) + (F.max(c) - F.min(c)) * 0.1] * 65))
    got = M.values_at(df, "v", ["g"], {"x": lambda n: F.floor(n / 2), "y": lambda n: F.floor(n / 20)}, few=50).collect()
    assert [tuple(r) for r in got] == [(0, 999.0, 99.0)]


def test_ranks_between_two_values(spark):
    """Ranks at the border of two frequent values are found; narrowing by sketches never ended there."""
    rows = [(g, float(v)) for g in (1, None) for v in [1] * 125 + [2] * 125 + [3] * 4]
    df = spark.createDataFrame(rows, "g int, v double")
    got = M.values_at(df, "v", ["g"], {"a": lambda n: F.lit(125), "b": lambda n: F.lit(126), "c": lambda n: n}, few=2).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 1.0, 2.0, 3.0), (None, 1.0, 2.0, 3.0)], key=repr)


def test_ranges_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(O, "RANGES", 8, raising=False)
    index = O.order_index(spark.range(1000), ["id"], 10)
    assert len(index.before) <= 8 and [r.id for r in index.page(437, 60).orderBy("_n").collect()] == list(range(437, 497))
    monkeypatch.setattr(O, "RANGE_ROWS", 50)
    assert len(O.order_index(spark.range(1000), ["id"], 10).before) > 15
