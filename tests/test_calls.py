"""Calls for each item with errors as rows, the throttle over tasks, and the paged source as a stream."""

import json
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kgspark.sources.paged import PagedSource, Throttle, call_each, sharers
from tests import clients

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
CLIENT = "tests.clients:noted"


def seeds_of(folder, sizes, **faults):
    return [{"id": i, "n": n, "folder": str(folder), "fail": faults.get(f"f{i}")} for i, n in enumerate(sizes)]


def items(spark, seeds):
    return spark.createDataFrame([(s["id"], json.dumps(s)) for s in seeds] + [(99, None)], "item int, params string")


def test_one_call_a_page_and_errors_as_rows(spark, tmp_path):
    seeds = seeds_of(tmp_path, [0, 3, 7, 7, 7], f3="good", f4="once")
    rows = call_each(items(spark, seeds), "params", CLIENT, page_size=3, concurrency=2).drop("params")
    assert rows.columns == ["item", "page", "ord", "raw", "error"]
    got = rows.collect()
    ok = {(r.item, r.page, r.ord) for r in got if r.error is None}
    assert ok == {(1, 0, k) for k in range(3)} | {(i, k // 3, k) for i in (2, 4) for k in range(7)} | {(3, 0, k) for k in range(3)}
    assert [(r.item, r.page, r.ord, r.error) for r in got if r.error] == [(3, 1, None, "SourceError: gone")]
    calls = Counter(n["seed"] for n in clients.notes(tmp_path))
    assert calls == {0: 1, 1: 1, 2: 3, 3: 2, 4: 4}
    with pytest.raises(Exception, match="gone"):
        call_each(items(spark, seeds), "params", CLIENT, page_size=3, concurrency=2, on_error="fail").collect()


def test_since_ends_an_item_early(spark, tmp_path):
    rows = call_each(items(spark, seeds_of(tmp_path, [20])), "params", CLIENT, page_size=3, since="2024-01-24").collect()
    assert sorted(r.ord for r in rows) == [0, 1, 2, 3, 4] and len(clients.notes(tmp_path)) == 3


def test_tasks_together_stay_under_the_limit(spark, tmp_path):
    """Four tasks, a limit of ten calls in half a second: no such span of time has more, whichever tasks they came from."""
    seeds = seeds_of(tmp_path, [6] * 16)
    assert call_each(items(spark, seeds), "params", CLIENT, page_size=2, concurrency=4, limit=10, window=0.5).count() == 96
    times = sorted(n["t"] for n in clients.notes(tmp_path))
    assert len(times) == 48
    assert max(sum(t <= u < t + 0.49 for u in times) for t in times) <= 10
    assert times[-1] - times[0] > 1.5


@pytest.mark.parametrize("limit, concurrency", [(10, 4), (3, 20), (1, 1), (7, 7)])
def test_shares(limit, concurrency):
    tasks = sharers(concurrency, limit)
    now = [0.0]
    throttles = [Throttle(limit, 1.0, tasks, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s)) for _ in range(tasks)]
    calls = []
    for t in throttles:
        now[0] = 0.0
        for _ in range(12):
            t.wait()
            calls.append(now[0])
    assert all(sum(a <= b < a + 1.0 - 1e-9 for b in calls) <= limit for a in calls)


def test_paged_source_deals_seeds_to_tasks(spark, tmp_path):
    spark.dataSource.register(PagedSource)
    seeds = seeds_of(tmp_path, [4, 5, 6, 7], f1="good")
    source = spark.read.format("paged").option("client", CLIENT).option("seeds", json.dumps(seeds)).option("page_size", "3").option("concurrency", "2").option("on_error", "row")
    df = source.load()
    assert df.rdd.getNumPartitions() == 2
    got = df.select(F.get_json_object("seed", "$.id").cast("int").alias("id"), "ord", "error").collect()
    assert sorted((r.id, r.ord) for r in got if r.error is None) == [(i, k) for i, n in ((0, 4), (1, 3), (2, 6), (3, 7)) for k in range(n)]
    assert [(r.id, r.error) for r in got if r.error] == [(1, "SourceError: gone")]


def test_stream_reads_each_page_once(spark, tmp_path):
    spark.dataSource.register(PagedSource)
    calls = tmp_path / "calls"
    calls.mkdir()
    for sizes in ([7, 3], [7, 10], [12, 10], [12, 10]):
        seeds = seeds_of(calls, [100, 100])
        # The seeds are the same; how far they reach grows.
        source = spark.readStream.format("paged").option("client", "tests.test_calls:growing").option("seeds", json.dumps([{**s, "n": 100} for s in seeds])).option("page_size", "3")
        (tmp_path / "sizes").write_text(json.dumps(sizes))
        for s in seeds:
            (calls.parent / f"size{s['id']}").write_text(str(sizes[s["id"]]))
        q = source.load().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select(F.get_json_object("seed", "$.id").cast("int").alias("id"), "ord", F.get_json_object("raw", "$.k").cast("int").alias("k")).collect()
    assert sorted((r.id, r.ord) for r in got) == [(0, k) for k in range(12)] + [(1, k) for k in range(10)]
    assert all(r.ord == r.k for r in got)
    read = Counter((n["seed"], n["cursor"]) for n in clients.notes(calls))
    assert max(read.values()) == 1


def growing(seed, cursor, page_size):
    return clients.noted(seed, cursor, page_size)


def growing_end(seed):
    return int((Path(seed["folder"]).parent / f"size{seed['id']}").read_text())


def test_pages_of_a_file_read_it_once(tmp_path):
    """Pages one after another are slices of one forward read, in any number of row groups; other orders give the same rows."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from kgspark.sources import paged as P

    path = str(tmp_path / "t.parquet")
    pq.write_table(pa.table({"k": range(1000), "v": [k % 7 for k in range(1000)]}), path, row_group_size=64)
    for client, seed, want in ((P.parquet_pages, {"path": path}, list(range(1000))), (P.parquet_matches, {"path": path, "column": "v", "value": 3, "columns": ["k"]}, list(range(3, 1000, 7)))):
        P._opened.cache_clear()
        got, cursor = [], None
        while True:
            rows, cursor = client(seed, cursor, 5)
            got += [json.loads(r)["k"] for r in rows]
            if cursor is None:
                break
        assert got == want and P._opened.cache_info().misses == 1
        for at in (130, 65, 0, 995, 141):
            assert [json.loads(r)["k"] for r in client(seed, at, 5)[0]] == want[at : at + 5]
    assert P.parquet_pages_end({"path": path}) == 1000


def test_stream_deals_runs_of_pages_to_tasks(spark):
    """A micro-batch has a task for many pages, not for each."""
    from kgspark.sources.paged import TASK_PAGES, PagedStream

    stream = PagedStream({"client": CLIENT, "seeds": "[1]", "page_size": "3"})
    runs = [p.value for p in stream.partitions({"1": 6}, {"1": 3 * 2500 + 1})]
    assert len(runs) == -(-2499 // TASK_PAGES) and sum(n for *_, n in runs) == 3 * 2498 + 1 and all(at % 3 == 0 for _, at, _ in runs)
