"""Sessions and anchored windows of arriving rows, equal to the batch ones on closed data (K9).

Rows wait in keyed state until the watermark has passed them, so they are grouped in time order however they arrive
within the lateness; what is emitted leaves the state, and open groups go when no later row can join them.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Keys are dealt to so many buckets by hash; calls of the state store cost by bucket, not by key or row.
BUCKETS = 1024
_WAITING = ["group_key", "seconds", "place", "same"]


class _Groups(StatefulProcessor):
    """State of a bucket of keys, packed: frames of rows that wait, and each key's open group (anchor, last, same)."""

    def __init__(self, length: float, anchored: bool):
        self.length, self.anchored = length, anchored

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "packed binary")
        self.open = handle.getValueState("open", "packed binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = []
        for batch in rows:
            if len(batch):
                self.rows.appendValue((pickle.dumps(batch[_WAITING]),))
                latest.append(float(batch["seconds"].max()))
        if latest:
            # One timer for what has come now: all of it is due when its latest row is.
            self.handle.registerTimer(math.ceil(max(latest) * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        packed = self.open.get()
        opened = pickle.loads(bytes(packed[0])) if packed else {}
        frames = [pickle.loads(bytes(r[0])) for r in self.rows.get()]
        if frames:
            waiting = pd.concat(frames, ignore_index=True)
            of = waiting["seconds"] <= now
            due, rest = waiting[of].sort_values(["group_key", "seconds", "place"]), waiting[~of]
            if len(rest) == 0:
                self.rows.clear()
            elif len(due):
                self.rows.put([(pickle.dumps(rest),)])
            if len(due):
                yield self._grouped(due, opened)
        # Rows still to come are later than the watermark; groups that they cannot join are forgotten.
        ends = {k: (anchor if self.anchored else last) + self.length for k, (anchor, last, _) in opened.items()}
        opened = {k: v for k, v in opened.items() if ends[k] > now}
        if opened:
            self.open.update((pickle.dumps(opened),))
            # By the latest end all of these can be forgotten.
            self.handle.registerTimer(math.ceil(max(ends.values()) * 1000))
        elif packed:
            self.open.clear()

    def _grouped(self, due: pd.DataFrame, opened: dict) -> pd.DataFrame:
        """The beginning of each row's group; ``opened`` gets each key's last one."""
        starts = []
        before, anchor, last, same = None, None, None, None
        for k, s, c in zip(due["group_key"].tolist(), due["seconds"].tolist(), due["same"].where(due["same"].notna(), None).tolist(), strict=True):
            if k != before:
                if before is not None:
                    opened[before] = anchor, last, same
                anchor, last, same = opened.get(k, (None, None, None))
                before = k
            if anchor is None or s - (anchor if self.anchored else last) > self.length or c != same:
                anchor = s
            last, same = s, c
            starts.append(anchor)
        opened[before] = anchor, last, same
        return pd.DataFrame({"group_key": due["group_key"].to_numpy(), "place": due["place"].to_numpy(), "group_start": starts})

    def close(self) -> None:
        pass


def stream_groups(events: DataFrame, key: str, ts: str, order: str, length: float, same: Column | None = None, anchored: bool = True, late: str = "10 minutes") -> DataFrame:
    """Group arriving rows: ``key``, ``order`` and group_start (seconds) of each, emitted once the watermark has passed it.

    ``anchored``: windows of ``length`` seconds from their first row (E2), else sessions with gaps up to ``length``
    (E3); a change of ``same`` (text) begins a group too. Rows later than the watermark and rows without key or order are dropped.
    Keys are dealt to BUCKETS by hash; a task holds the rows of one bucket that arrived within the lateness.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    s = (F.unix_micros(ts) / 1e6).alias("seconds")
    rows = events.withWatermark(ts, late).where(F.col(key).isNotNull() & F.col(order).isNotNull())
    rows = rows.select(F.col(key).alias("group_key"), ts, s, F.col(order).cast("long").alias("place"), (F.lit(None) if same is None else same).cast("string").alias("same"))
    kind = rows.schema["group_key"].dataType.simpleString()
    out = rows.withColumn("bucket", F.pmod(F.hash("group_key"), F.lit(BUCKETS))).groupBy("bucket").transformWithStateInPandas(_Groups(length, anchored), f"group_key {kind}, place long, group_start double", "Append", "EventTime")
    return out.select(F.col("group_key").alias(key), F.col("place").alias(order), "group_start")
