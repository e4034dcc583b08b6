"""Sessions and windows over ranges equal a walk through the rows, however few rows a range has."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.operators import grouping as G
from kgspark.operators import ranges


def walked_windows(rows, window):
    out, anchor, before = {}, None, None
    for page, s, i, kind in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        if before != (page, kind) or s > anchor + window:
            anchor = s
        before = (page, kind)
        out[i] = anchor
    return out


def walked_sessions(rows, timeout, context):
    out, last = {}, {}
    for user, s, i, kind in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1], r[2])):
        n, start, t, k = last.get(user, (-1, s, None, None))
        if t is None or s - t > timeout or (context and k != kind):
            n, start = n + 1, s
        last[user] = (n, start, s, kind)
        out[i] = (n, start)
    return out


def made(n, pages, spread, kinds, seed, change=0.0):
    rng = np.random.default_rng(seed)
    kind = np.zeros(n, int)
    s = np.round(np.sort(rng.integers(0, spread, n)) + rng.integers(0, 2, n) * 0.5, 1)
    flips = np.cumsum(rng.random(n) < change) % kinds
    return [(None if p == 0 and pages > 1 else int(p), float(s[i]), i, str(kind[i] + flips[i])) for i, p in enumerate(rng.integers(0, pages, n))]


@pytest.mark.parametrize(
    "n, pages, spread, window, size, change",
    [(400, 1, 4000, 60, 40, 0), (400, 1, 4000, 1500, 30, 0), (300, 1, 300, 3, 25, 0.02), (400, 4, 2000, 100, 50, 0.01), (60, 1, 5, 100, 7, 0), (200, 1, 10**6, 20, 10, 0), (300, 2, 900, 9, 5, 0)],
)
def test_windows(spark, n, pages, spread, window, size, change):
    rows = made(n, pages, spread, 3, n + size, change)
    df = spark.createDataFrame(rows, "page int, s double, ord long, kind string").repartition(3)
    got = G.time_windows(df, F.col("s"), window, "page", ["kind"], most=size)
    assert got.columns == ["page", "s", "ord", "kind", "group_start"]
    assert {r.ord: r.group_start for r in got.collect()} == walked_windows(rows, window)
    whole = G.time_windows(df, F.col("s"), window, "page", ["kind"])
    assert sorted(map(tuple, whole.select(got.columns).collect()), key=str) == sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("n, users, spread, timeout, size, context", [(400, 1, 4000, 30, 30, None), (400, 4, 4000, 60, 50, "kind"), (300, 1, 10**6, 5, 20, None), (300, 1, 100, 5000, 20, None), (200, 9, 900, 20, 12, "kind")])
def test_sessions(spark, n, users, spread, timeout, size, context):
    rows = made(n, users, spread, 2, n + size, 0.05)
    df = spark.createDataFrame(rows, "user int, s double, ord long, kind string").repartition(3)
    got = G.user_sessions(df, "user", F.col("s"), context, timeout, most=size)
    assert {r.ord: (r.session, r.session_start) for r in got.collect()} == walked_sessions(rows, timeout, context)
    assert got.columns == ["user", "s", "ord", "kind", "session", "session_start"]


def test_a_hot_page_is_spread(spark):
    rows = made(1000, 1, 50_000, 1, 5)
    df = spark.createDataFrame(rows, "page int, s double, ord long, kind string").withColumn("_s", F.col("s"))
    parts = ranges.in_ranges(df, ["page", "_s", "ord"], 100).groupBy("_part").count().collect()
    assert len(parts) >= 8 and max(r["count"] for r in parts) < 300


def test_no_rows(spark):
    df = spark.createDataFrame([], "page int, s double, ord long, kind string")
    assert G.time_windows(df, F.col("s"), 5, "page", most=0).count() == 0
    assert ranges.windows(df.withColumn("_s", F.col("s")), 5, "page", [], "ord").count() == 0
    assert ranges.sessions(df.withColumn("_s", F.col("s")), "page", None, 5, "ord").count() == 0
