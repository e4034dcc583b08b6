"""A paged source as a Python data source, in batch and as a stream, and calls for each item of an earlier result.

Register with ``spark.dataSource.register(PagedSource)`` and read with ``spark.read.format("paged")``. Options:
``client`` (module:function that returns a page), ``seeds`` (JSON list), ``page_size``, ``since``, ``retries``,
``concurrency`` (tasks that call at a time), ``limit`` and ``window`` (calls in so many seconds, over all tasks) and
``on_error`` (``fail``, or ``row`` for a row with the error's text in place of a seed's pages).
A client is called as ``client(seed, cursor, page_size)`` and returns (rows, next cursor or None); a row is JSON text
and may hold a date under ``date``. Reading a seed stops after a page whose rows are all before ``since`` (A8).
"""

from __future__ import annotations

import functools
import importlib
import json
import os
import random
import time
from collections import deque
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

#: First and longest pause between tries, in seconds.
PAUSE, LONGEST = 0.1, 5.0
#: Rows of a file that are read, and rows of calls that are handed on, at a time.
BATCH = 8192
#: Pages of a stream that one task reads, one after another.
TASK_PAGES = 1000
SCHEMA = "seed string, page int, ord long, raw string, error string"


class SourceError(Exception):
    """A fault that trying again does not mend."""


class Seeds(InputPartition):
    """Starting values that one task reads, one after another."""

    def __init__(self, values: list):
        super().__init__(values)


def named(client: str) -> Callable:
    module, name = client.split(":")
    return getattr(importlib.import_module(module), name)


class Throttle:
    """One task's lease of a source's rate (A9): of ``limit`` calls in any ``window`` seconds it has its share.

    At most ``limit`` tasks may call (see :func:`sharers`), so that the whole calls of all shares never exceed it.
    """

    def __init__(self, limit: int, window: float, tasks: int, clock=time.monotonic, sleep=time.sleep):
        self.share, self.window, self.clock, self.sleep = max(1, limit // max(1, tasks)), window, clock, sleep
        self.calls: deque = deque()

    def wait(self) -> None:
        """Return once a call is allowed, and count it."""
        while len(self.calls) >= self.share:
            left = self.calls[0] + self.window - self.clock()
            if left <= 0:
                self.calls.popleft()
            else:
                self.sleep(left)
        self.calls.append(self.clock())


def sharers(concurrency: int, limit: int | None) -> int:
    """How many tasks may call at a time."""
    return max(1, min(concurrency, limit) if limit else concurrency)


def call(client, *args, retries: int = 5, sleep=time.sleep, throttle: Throttle | None = None):
    """A call tried again with growing pauses (A9); a SourceError is passed on at once. Each try counts for the throttle."""
    pause = PAUSE
    for attempt in range(retries + 1):
        try:
            if throttle:
                throttle.wait()
            return client(*args)
        except SourceError:
            raise
        except Exception:
            if attempt == retries:
                raise
            sleep(min(LONGEST, pause) * (0.5 + random.random() / 2))
            pause *= 2


def pages(client, seed, page_size: int, since: str | None, retries: int, throttle: Throttle | None, on_error: str, first_only: bool = False) -> Iterator[tuple]:
    """(page, ord, raw, error) of all pages of a starting value (A8), or of the first one; where a call fails for good, one row with its error ends them."""
    cursor, page, at = None, 0, 0
    while True:
        try:
            rows, cursor = call(client, seed, cursor, page_size, retries=retries, throttle=throttle)
        except Exception as e:
            if on_error == "fail":
                raise
            yield page, None, None, f"{type(e).__name__}: {e}"
            return
        kept = 0
        for raw in rows:
            date = json.loads(raw).get("date") if since else None
            if date is None or date >= since:
                kept += 1
                yield page, at, raw, None
            at += 1
        page += 1
        if first_only or not cursor or (since and rows and not kept):
            return


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.client = options["client"]
        self.seeds = json.loads(options.get("seeds", "[null]"))
        self.page_size = int(options.get("page_size", "100"))
        self.since = options.get("since")
        self.retries = int(options.get("retries", "5"))
        self.on_error = options.get("on_error", "fail")
        self.limit = int(options["limit"]) if "limit" in options else None
        self.window = float(options.get("window", "1"))
        self.tasks = sharers(int(options.get("concurrency", str(len(self.seeds)))), self.limit)

    def partitions(self):
        return [Seeds(self.seeds[k :: self.tasks]) for k in range(min(self.tasks, len(self.seeds)))]

    def read(self, partition) -> Iterator[tuple]:
        client, throttle = named(self.client), Throttle(self.limit, self.window, self.tasks) if self.limit else None
        for seed in partition.value:
            for row in pages(client, seed, self.page_size, self.since, self.retries, throttle, self.on_error):
                yield json.dumps(seed), *row


class Range(InputPartition):
    """Pages of a stream one after another: a seed's rows from a position on."""

    def __init__(self, seed, start: int, size: int):
        super().__init__((seed, start, size))


class PagedStream(DataSourceStreamReader):
    """New rows of seeds whose cursors are positions (K1, K3).

    An offset is each seed's position; it lies in the query's checkpoint, so a restarted stream goes on where it stopped.
    ``<client>_end(seed)`` tells how many rows a seed has; ``until`` leaves later ones for another time. A micro-batch
    is planned as runs of up to TASK_PAGES pages, each run read by a task, a call a page. The source keeps all rows, so there is nothing to do on commit.
    """

    def __init__(self, options: dict):
        self.client, self.seeds = options["client"], json.loads(options.get("seeds", "[null]"))
        self.page_size, self.retries = int(options.get("page_size", "100")), int(options.get("retries", "5"))
        self.until = int(options["until"]) if "until" in options else None

    def initialOffset(self) -> dict:
        return {json.dumps(s): 0 for s in self.seeds}

    def latestOffset(self) -> dict:
        end = named(f"{self.client}_end")
        ends = {json.dumps(s): call(end, s, retries=self.retries) for s in self.seeds}
        return {k: n if self.until is None else min(n, self.until) for k, n in ends.items()}

    def partitions(self, start: dict, end: dict):
        run = TASK_PAGES * self.page_size
        return [Range(json.loads(k), at, min(run, n - at)) for k, n in end.items() for at in range(start.get(k, 0), n, run)]

    def read(self, partition) -> Iterator[tuple]:
        seed, start, size = partition.value
        client, name = named(self.client), json.dumps(seed)
        for at in range(start, start + size, self.page_size):
            rows, _ = call(client, seed, at, min(self.page_size, start + size - at), retries=self.retries)
            for k, raw in enumerate(rows):
                yield name, at // self.page_size, at + k, raw, None

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    """Rows (seed, page, ord, raw, error) of a paged client."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedStream(self.options)


def call_each(
    items: DataFrame, params: str, client: str, page_size: int = 100, concurrency: int = 20, limit: int | None = None, window: float = 1.0, since: str | None = None, retries: int = 5, on_error: str = "row", first_only: bool = False
) -> DataFrame:
    """All pages of a call for each row of ``items`` (A5, A6): its columns with page, ord, raw and error.

    ``params``: a column of JSON text, the client's starting value; a null makes no call. Rows of ``items`` are dealt to ``concurrency`` tasks, each
    of which calls for one after another under its share of the rate. An item whose call fails for good has one row
    with the error, and the others go on (``on_error="fail"`` ends the job instead); an item without rows has none.
    """
    tasks = sharers(concurrency, limit)
    place = items.columns.index(params)
    out = StructType([*items.schema.fields]).add("page", IntegerType()).add("ord", LongType()).add("raw", StringType()).add("error", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, throttle = named(client), Throttle(limit, window, tasks) if limit else None
        for batch in batches:
            for i, given in enumerate(batch.column(place).to_pylist()):
                if given is None:
                    continue
                rows = pages(f, json.loads(given), page_size, since, retries, throttle, on_error, first_only)
                while part := list(islice(rows, BATCH)):
                    own = batch.take(pa.array([i] * len(part), pa.int64())).columns
                    new = [pa.array(v, t) for v, t in zip(zip(*part, strict=True), (pa.int32(), pa.int64(), pa.string(), pa.string()), strict=True)]
                    yield pa.record_batch([*own, *new], [f.name for f in out.fields])

    return items.repartition(tasks).mapInArrow(run, out)


class _Rows:
    """Rows of a Parquet file or folder, or those of them that a filter keeps, read forward in batches.

    A page after the last one costs only its own rows; another one is looked for from the first row group that may hold it.
    """

    def __init__(self, path: str, columns: list[str] | None, test):
        import pyarrow.dataset as ds

        self.columns, self.test, self.groups = columns, test, []
        for file in ds.dataset(path, format="parquet").get_fragments():
            self.groups += [(file, g.id, g.num_rows) for g in (file.row_groups if test is None else file.subset(test).row_groups)]
        self.total = sum(n for *_, n in self.groups)
        self._seek(0)

    def _seek(self, start: int) -> None:
        first, self.at = 0, 0
        while self.test is None and first < len(self.groups) and self.at + self.groups[first][2] <= start:
            self.at += self.groups[first][2]
            first += 1
        self.held: list[dict] = []
        self.batches = (b for f, g, _ in self.groups[first:] for b in f.subset(row_group_ids=[g]).to_batches(columns=self.columns, filter=self.test, batch_size=BATCH, use_threads=False))

    def page(self, start: int, size: int) -> tuple[list[dict], bool]:
        """Rows ``start`` to ``start + size``, and whether there are more."""
        if start < self.at:
            self._seek(start)
        while self.at + len(self.held) <= start + size and (batch := next(self.batches, None)) is not None:
            gone = min(start - self.at, len(self.held))
            self.held, self.at = self.held[gone:], self.at + gone
            if not self.held and self.at + batch.num_rows <= start:
                self.at += batch.num_rows
            else:
                self.held += batch.to_pylist()
        k = start - self.at
        return self.held[k : k + size], len(self.held) > k + size


@functools.lru_cache(maxsize=1)
def _opened(path: str, stamp: int | None, columns: tuple | None, test: str | None) -> _Rows:
    """The rows that this process read last; ``stamp`` tells a file that was written anew, ``test`` is a column and its value."""
    import pyarrow.dataset as ds

    column, value = json.loads(test) if test else (None, None)
    return _Rows(path, list(columns) if columns else None, None if column is None else ds.field(column) == value)


def _rows(seed: dict) -> _Rows:
    path, columns = seed["path"], seed.get("columns")
    test = json.dumps([seed["column"], seed["value"]]) if "column" in seed else None
    return _opened(path, os.stat(path).st_mtime_ns if os.path.exists(path) else None, tuple(columns) if columns else None, test)


def parquet_pages(seed: dict, cursor: int | None, page_size: int) -> tuple[list[str], int | None]:
    """A client of the paged source over a Parquet file: seed ``{"path": ...}``, the cursor being a row's number.

    Row groups before the page are not read, and pages one after another read each row group once.
    """
    skip = cursor or 0
    rows, more = _rows({"path": seed["path"]}).page(skip, page_size)
    return [json.dumps(r, default=str) for r in rows], skip + page_size if more else None


def parquet_pages_end(seed: dict) -> int:
    """How many rows a Parquet file has."""
    return _rows({"path": seed["path"]}).total


def parquet_matches(seed: dict, cursor: int | None, page_size: int) -> tuple[list[str], int | None]:
    """A client over a Parquet file's rows with a value: seed ``{"path", "column", "value"}``; row groups that cannot hold it are not read."""
    skip = cursor or 0
    rows, more = _rows(seed).page(skip, page_size)
    return [json.dumps(r, default=str) for r in rows], skip + page_size if more else None
