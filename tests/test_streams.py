"""Streams of several micro-batches against batch results on closed data."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.operators import grouping as B
from kgspark.streaming import groups as G

START = datetime.datetime(2024, 3, 1)


@pytest.mark.parametrize("anchored", [True, False])
def test_groups_over_micro_batches(spark, tmp_path, anchored):
    rng = np.random.default_rng(3)
    seconds = np.sort(rng.integers(0, 5000, 240))
    rows = [(int(k), i, "ab"[int(rng.integers(0, 20)) // 19], START + datetime.timedelta(seconds=int(s))) for i, (k, s) in enumerate(zip(rng.integers(0, 3, 240), seconds, strict=True))]
    schema = "user int, ord long, kind string, ts timestamp"
    batches = [rows[:100], rows[100:170], rows[170:]]
    closing = [(9, 10_000, "a", START + datetime.timedelta(days=2))]
    states = []
    for k, part in enumerate([*batches, closing]):
        # Within a batch rows come in any order; the lateness allows some of the next batch's to be earlier than the last ones here.
        spark.createDataFrame([part[i] for i in rng.permutation(len(part))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        out = G.stream_groups(stream, "user", "ts", "ord", 60, F.col("kind"), anchored, "2 minutes")
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        states.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    df = spark.createDataFrame(rows, schema)
    s = F.unix_micros("ts") / 1e6
    if anchored:
        want = {r.ord: r.group_start for r in B.time_windows(df, s, 60, "user", ["kind"]).collect()}
    else:
        want = {r.ord: r.session_start for r in B.user_sessions(df, "user", s, "kind", 60).collect()}
    got = [r for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.user != 9]
    assert {r.ord: r.group_start for r in got} == want and len(got) == len(rows)
    # Only the closing row and its timer are left.
    assert states[-1] < states[0]


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "user int, ord long, ts timestamp"
    parts = [[(1, 1, START), (1, 2, START + datetime.timedelta(hours=1))], [(1, 3, START + datetime.timedelta(minutes=1)), (2, 4, START + datetime.timedelta(days=1))]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = G.stream_groups(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "user", "ts", "ord", 60, late="1 minute")
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.ord for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]
