"""Sessions and anchored windows of keys that have more rows than a task should hold.

Rows are dealt to ranges of (key, time, order) and written, so a hot key is spread over as many ranges as its rows
need. Each range is worked on by itself; what goes from one to the next is told by the ranges' edges, a row a range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.session import written

#: Rows of a range.
RANGE_ROWS = 500_000
#: Places of a range's rows in a number that names a row.
_PLACES = 40


def in_ranges(rows: DataFrame, by: list[str], size: int = RANGE_ROWS) -> DataFrame:
    """``rows``, written with ``_part``: ranges of about ``size`` rows in the order of ``by``; rows equal in all of ``by`` stay together."""
    parts = max(1, -(-rows.count() // size))
    return written(rows.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()))


def hot(rows: DataFrame, key: str, most: int) -> bool:
    """Whether some key has more than ``most`` rows; counts are added up before they are shuffled."""
    return (rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > most


def _with_new(rows: DataFrame, key: str, compared: list[str], order: str, starts) -> DataFrame:
    """Add ``_new``: whether ``starts(before, row)`` holds, with the row before in this range or at the end of the last one."""
    at = F.struct(key, "_s", order)
    whole = F.struct(*dict.fromkeys([key, "_s", *compared]))
    ends = rows.groupBy("_part").agg(F.max_by(whole, at).alias("_end"))
    ends = ends.withColumn("_last", F.lag("_end").over(Window.orderBy("_part"))).select("_part", "_last")
    w = Window.partitionBy("_part").orderBy(key, "_s", order)
    rows = rows.join(F.broadcast(ends), "_part").withColumn("_b", F.coalesce(F.lag(whole).over(w), F.col("_last")))
    return rows.withColumn("_new", F.col("_b").isNull() | ~F.col(key).eqNullSafe(F.col(f"_b.{key}")) | starts(F.col("_b"))).drop("_b", "_last")


def sessions(rows: DataFrame, user: str, context: str | None, timeout: int, order: str, size: int = RANGE_ROWS) -> DataFrame:
    """Add session (per user, from 0) and session_start to rows with ``_s`` (seconds), as :func:`grouping.user_sessions` says."""
    gap = lambda b: (F.col("_s") - b["_s"] > timeout) | (~F.col(context).eqNullSafe(b[context]) if context else F.lit(False))
    rows = _with_new(in_ranges(rows, [user, "_s", order], size), user, [context] if context else [], order, gap)
    own = Window.partitionBy("_part", user).orderBy("_s", order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_n": F.sum(F.col("_new").cast("long")).over(own), "_start": F.last(F.when(F.col("_new"), F.col("_s")), ignorenulls=True).over(own)})
    at = F.struct(user, "_s", order)
    # A row a range: its last user with the sessions that begin here, and the last beginning.
    edge = rows.groupBy("_part").agg(F.max_by(F.struct(F.col(user).alias("u"), "_n", "_start"), at).alias("e"))
    line = Window.orderBy("_part")
    edge = edge.withColumns({"_sum": F.sum("e._n").over(Window.partitionBy("e.u").orderBy("_part")), "_open": F.last("e._start", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))})
    edge = edge.select("_part", F.lag("e.u").over(line).alias("_u"), F.lag("_sum").over(line).alias("_before"), F.lag("_open").over(line).alias("_open"))
    goes_on = F.col(user).eqNullSafe(F.col("_u"))
    rows = rows.join(F.broadcast(edge), "_part")
    rows = rows.withColumn("session", F.col("_n") + F.when(goes_on, F.col("_before")).otherwise(0) - 1).withColumn("session_start", F.coalesce("_start", F.when(goes_on, F.col("_open"))))
    return rows.drop("_part", "_new", "_n", "_start", "_u", "_before", "_open", "_s")


def next_anchors(run: np.ndarray, s: np.ndarray, window: float) -> np.ndarray:
    """For each row of sorted runs the first later one that begins a window if this one did: past the window or in the next run."""
    levels = np.unique(s)
    width = len(levels) + 1
    return np.searchsorted(run * width + np.searchsorted(levels, s), run * width + np.searchsorted(levels, s + window, "right"))


def _last(after: np.ndarray) -> np.ndarray:
    """The last row of the chain from each row, by doubling; rows that lead out of the range end it."""
    n = len(after)
    jump = np.where(after < n, after, np.arange(n))
    while True:
        twice = jump[jump]
        if (twice == jump).all():
            return jump
        jump = twice


def _reached(after: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Flags of the rows that chains from ``begin`` go through, by doubling."""
    n = len(after)
    on, jump = np.append(begin, False), np.append(np.minimum(after, n), n)
    while True:
        more = on.copy()
        more[jump[np.flatnonzero(on)]] = True
        if (jump == n).all():
            return more[:-1]
        on, jump = more, jump[jump]


class _Edges:
    """What each range's ends are: whether a run begins in it, and its last time."""

    def __init__(self, rows: list):
        parts = 1 + max((r["_part"] for r in rows), default=-1)
        self.any_new, self.last, self.has = np.ones(parts, bool), np.full(parts, np.inf), np.zeros(parts, bool)
        for r in rows:
            self.any_new[r["_part"]], self.last[r["_part"]], self.has[r["_part"]] = r["any_new"], r["last"], True
        self.parts = np.flatnonzero(self.has)

    def to(self, part: int, anchor: np.ndarray, window: float) -> np.ndarray:
        """The range after ``part`` in which a run that is open at its end, with the window of ``anchor``, begins its next window or ends; -1 for none."""
        after = self.parts[self.parts > part]
        if not len(after):
            return np.full(len(anchor), -1)
        ends = np.flatnonzero(self.any_new[after])
        through = after[: ends[0] if len(ends) else len(after)]
        k = np.searchsorted(self.last[through], anchor + window, "right")
        return np.append(through, after[ends[0]] if len(ends) else -1)[k]


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of a range's rows, their times and their beginnings."""
    order = np.argsort(table.column("_i").to_numpy())
    return order, table.column("_s").to_numpy()[order], table.column("_new").to_numpy()[order]


def _exits(edges: _Edges, window: float):
    """Of a range's last run: the last anchor, or, if it began before, the last anchor for each row that might be its first one here."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("_part")[0].as_py()
        _, s, new = _columns(table)
        begins = np.flatnonzero(new)
        if len(begins):
            own = s[begins[-1] :]
            last = _last(next_anchors(np.zeros(len(own), np.int64), own, window))[:1]
            entry, anchor = np.array([-1]), own[last]
        else:
            # An anchor before this range is not later than its first row, so only the rows of that row's window and the next one can be first.
            head = min(len(s), int(np.searchsorted(s, s[0] + window, "right")) + 1)
            entry = np.arange(head)
            anchor = s[_last(next_anchors(np.zeros(len(s), np.int64), s, window))[:head]]
        to = edges.to(part, anchor, window)
        return pa.table({"part": np.full(len(entry), part, np.int64), "entry": entry.astype(np.int64), "anchor": anchor, "to": to.astype(np.int64)})

    return run


def _entries(window: float):
    """The first row of a range that begins a window after each anchor that comes to it."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return pa.table({"to": pa.array([], pa.int64()), "anchor": pa.array([], pa.float64()), "next": pa.array([], pa.int64())})
        _, s, _ = _columns(rows)
        anchor = asked.column("anchor").to_numpy()
        to = asked.column("to").to_numpy()
        return pa.table({"to": to, "anchor": anchor, "next": (to << _PLACES) + np.searchsorted(s, anchor + window, "right")})

    return run


def _grouped(anchors: dict[int, float], window: float):
    """Add group_start to the rows of a range, given the anchor that is open at its start."""

    def run(table: pa.Table) -> pa.Table:
        order, s, new = _columns(table)
        table = table.take(pa.array(order))
        runs = np.cumsum(new)
        after = next_anchors(runs, s, window)
        begin = new.copy()
        head = int(np.searchsorted(runs, 0, "right"))
        opened = anchors.get(table.column("_part")[0].as_py())
        if head and opened is not None:
            first = int(np.searchsorted(s[:head], opened + window, "right"))
            if first < head:
                begin[first] = True
        at = np.maximum.accumulate(np.where(_reached(after, begin), np.arange(len(s)), -1))
        start = np.where(at >= 0, s[np.maximum(at, 0)], opened if opened is not None else np.nan)
        return table.append_column("group_start", pa.array(start))

    return run


def windows(rows: DataFrame, window: float, page: str, same: list[str], order: str, size: int = RANGE_ROWS) -> DataFrame:
    """Add group_start to rows with ``_s`` (seconds), as :func:`grouping.time_windows` says.

    Within a range the next anchor of every row is found by a search among sorted times, and chains of anchors by
    doubling. A run that goes through whole ranges is followed from range to range: for each row that might begin a
    window first there, its range tells the last anchor and the range that this one leads to; these jumps are doubled
    as joins, so their number grows with the logarithm of the ranges.
    """
    changed = lambda b: F.lit(False) if not same else ~F.struct(*same).eqNullSafe(F.struct(*[b[c] for c in same]))
    rows = _with_new(in_ranges(rows, [page, "_s", order], size), page, same, order, changed)
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(page, "_s", order)))
    spark = rows.sparkSession
    # A row a range; fewer than rows / size.
    edges = _Edges(rows.groupBy("_part").agg(F.max("_new").alias("any_new"), F.max_by("_s", "_i").alias("last")).collect())
    narrow = rows.select("_part", "_i", "_s", "_new")
    exits = written(narrow.groupBy("_part").applyInArrow(_exits(edges, window), "part long, entry long, anchor double, to long"))
    known = exits.where("entry < 0").select("part", "anchor", "to")
    through = int((~edges.any_new[edges.parts]).sum())
    if through:
        asked = exits.where(F.col("to").isin([int(p) for p in edges.parts if not edges.any_new[p]]) if through <= 1000 else F.col("to") >= 0).select("to", "anchor").distinct()
        entered = written(narrow.groupBy("_part").cogroup(asked.groupBy("to")).applyInArrow(_entries(window), "to long, anchor double, next long"))
        node = ((F.col("part") * (1 << _PLACES)) + F.col("entry")).alias("node")
        jumps = [written(exits.where("entry >= 0").select("part", node, "anchor", "to").join(entered, ["to", "anchor"]).select("node", "next"))]
        start = known.join(entered, ["to", "anchor"]).select(F.col("next").alias("node")).distinct()
        for _ in range(through.bit_length()):
            j = jumps[-1]
            jumps.append(written(j.join(j.select(F.col("node").alias("next"), F.col("next").alias("then")), "next").select("node", F.col("then").alias("next"))))
        for j in reversed(jumps):
            start = written(start.union(start.join(j, "node").select(F.col("next").alias("node"))).distinct())
        more = exits.where("entry >= 0").select("part", node, "anchor", "to").join(start, "node").select("part", "anchor", "to")
        known = known.union(more)
    left = sorted((r["part"], r["anchor"]) for r in known.collect())  # at most one a range is on a chain
    opened: dict[int, float] = {}
    k = -1
    for p in edges.parts.tolist():
        while k + 1 < len(left) and left[k + 1][0] < p:
            k += 1
        if k >= 0:
            opened[p] = left[k][1]
    sent = spark.sparkContext.broadcast(opened)
    out = rows.select("*", F.lit(0.0).alias("group_start")).schema
    return rows.groupBy("_part").applyInArrow(_sent_grouped(sent, window), out).drop("_part", "_new", "_i", "_s")


def _sent_grouped(sent, window: float):
    def run(table: pa.Table) -> pa.Table:
        return _grouped(sent.value, window)(table)

    return run
