"""Grouping of records into threads, sessions, time windows and labelled conversations, and their parent records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.text import truthy
from kgspark.operators import ranges


def thread_groups(records: DataFrame, thread: Column, parent: Column | None = None, own: Column | None = None) -> DataFrame:
    """Add group_id: a record's thread, or its own id if it is marked a thread's parent; others are dropped."""
    key = F.when(truthy(thread.cast("string")), thread.cast("string"))
    if parent is not None and own is not None:
        key = F.coalesce(key, F.when(parent & truthy(own.cast("string")), own.cast("string")))
    return records.withColumn("group_id", key).where(F.col("group_id").isNotNull())


def user_sessions(records: DataFrame, user: str, seconds: Column, context: str | None = None, timeout: int = 1800, order: str = "ord", most: int = ranges.RANGE_ROWS) -> DataFrame:
    """Add session_start and session (per user, from 0): a gap over ``timeout`` or a new context starts one.

    Rows without a user are dropped. A gap that equals the timeout does not split. Where a user has more than ``most``
    rows, users are spread over ranges of so many; else a window a user is enough. ``order`` tells equal times apart.
    """
    rows = records.where(F.col(user).isNotNull()).withColumn("_s", seconds)
    if ranges.hot(rows, user, most):
        return ranges.sessions(rows, user, context, timeout, order, most)
    w = Window.partitionBy(user).orderBy("_s", order)
    new = F.lag("_s").over(w).isNull() | (F.col("_s") - F.lag("_s").over(w) > timeout)
    if context:
        new = new | ~F.col(context).eqNullSafe(F.lag(context).over(w))
    rows = rows.withColumn("session", F.sum(F.when(new, 1).otherwise(0)).over(w) - 1)
    return rows.withColumn("session_start", F.min("_s").over(Window.partitionBy(user, "session"))).drop("_s")


#: Sessions of a range in which numbers are counted on.
_RANGE = 50_000


def number_sessions(sessions: DataFrame, user: str) -> DataFrame:
    """One row a session with its number over all users, by each user's first activity.

    First activities are cut into ranges by approximate quantiles; a number is the count of sessions in earlier ranges
    and its place in its own, so no task sees all sessions. Only the ranges' counts are added up in one place.
    """
    per = sessions.groupBy(user, "session").agg(F.min("session_start").alias("start"), F.count("*").alias("n"))
    per = per.withColumn("first", F.min("start").over(Window.partitionBy(user)))
    rows = per.count()
    ranges = min(10_000, -(-rows // _RANGE))
    cuts = per.agg(F.percentile_approx("first", [k / ranges for k in range(1, ranges)], 100_000)).first()[0] if ranges > 1 else []
    bounds = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array(F.lit(None).cast("double"))
    placed = per.withColumn("_r", F.size(F.filter(bounds, lambda b: b < F.col("first"))))
    before = placed.groupBy("_r").agg(F.count("*").alias("_c")).withColumn("_before", F.sum("_c").over(Window.orderBy("_r")) - F.col("_c"))
    order = Window.partitionBy("_r").orderBy("first", user, "session")
    return placed.join(F.broadcast(before.select("_r", "_before")), "_r").withColumn("number", (F.col("_before") + F.row_number().over(order) - 1).cast("int")).drop("first", "_r", "_before")


def time_windows(records: DataFrame, seconds: Column, window: int, page: str, same: list[str] | None = None, order: str = "ord", most: int = ranges.RANGE_ROWS) -> DataFrame:
    """Add group_start: windows anchored at their first record, closed by time or by a change of ``same`` columns.

    Records are in one time order for each page. A change closes the group even if the old value comes back. Where a
    page has more than ``most`` rows, pages are spread over ranges of so many. Else runs without a change are found by
    windows in the plan, and only within a run are rows walked, as a sorted stream.
    """
    w = Window.partitionBy(page).orderBy("_s", order)
    rows = records.withColumn("_s", seconds.cast("double"))
    if ranges.hot(rows, page, most):
        return ranges.windows(rows, window, page, same or [], order, most)
    change = F.lag("_s").over(w).isNull()
    for c in same or []:
        change = change | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    rows = rows.withColumn("_run", F.sum(F.when(change, 1).otherwise(0)).over(w))
    schema = rows.select("*", F.lit(0.0).alias("group_start")).schema

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, anchor = None, 0.0
        for batch in batches:
            s, start = batch["_s"].to_numpy(), np.empty(len(batch))
            pages = batch[page].astype(object).where(batch[page].notna(), None)  # NaN would not equal itself
            keys = list(zip(pages, batch["_run"], strict=True))
            i = 0
            while i < len(s):
                if keys[i] != key or s[i] > anchor + window:
                    key, anchor = keys[i], s[i]
                j = i + 1
                while j < len(s) and keys[j] == key and s[j] <= anchor + window:
                    j += 1
                start[i:j] = anchor
                i = j
            yield batch.assign(group_start=start)

    runs = rows.repartition(page, "_run").sortWithinPartitions(page, "_run", "_s", order)
    return runs.mapInPandas(walk, schema).drop("_s", "_run")


def least_size(grouped: DataFrame, n: int, group: str = "group_id") -> DataFrame:
    """Without the records of smaller groups."""
    return grouped.withColumn("_n", F.count("*").over(Window.partitionBy(group))).where(F.col("_n") >= n).drop("_n")


def overlap_batches(records: DataFrame, size: int = 50, overlap: int = 10, order: str = "ord") -> DataFrame:
    """Rows dealt to batches of ``size`` that share ``overlap`` rows with the next (E5); needs ``ord`` from 0 without gaps."""
    step = size - overlap
    last = F.floor(F.col(order) / step)
    first = F.greatest(F.ceil((F.col(order) - size + 1) / step), F.lit(0))
    return records.withColumn("batch", F.explode(F.sequence(first.cast("long"), last.cast("long")))).withColumn("place", F.col(order) - F.col("batch") * step)


def labelled_groups(batches: DataFrame, label: Callable[[pd.DataFrame], list[int]], order: str = "ord") -> DataFrame:
    """Group each batch by a labeler, first assignment wins; group ids are those of their batch (E5).

    ``label`` gets a batch in order and returns a number for each row; where it fails, rows stay alone.
    """
    schema = batches.select("*", F.lit("").alias("group_id")).schema

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("place")
        try:
            numbers = list(label(batch))
            ids = [f"{b}_{n}" for b, n in zip(batch["batch"], numbers, strict=True)]
        except Exception:  # a labeler is outside code: its failure leaves singletons
            ids = [f"single_{o}" for o in batch[order]]
        return batch.assign(group_id=ids)

    named = batches.groupBy("batch").applyInPandas(run, schema)
    rest = [c for c in named.columns if c not in (order, "batch", "place", "group_id")]
    return named.groupBy(order).agg(F.min_by("group_id", "batch").alias("group_id"), *[F.min_by(c, "batch").alias(c) for c in rest])


def hybrid_groups(records: DataFrame, thread: Column, rest: Callable[[DataFrame], DataFrame], least: int = 2, key: str = "ord") -> DataFrame:
    """Threads, then another grouping of what is left; too small groups become single ones."""
    threads = least_size(thread_groups(records, thread), least)
    others = records.join(threads.select(key), key, "left_anti")
    found = least_size(rest(others), least).select(*threads.columns)
    single = others.join(found.select(key), key, "left_anti").withColumn("group_id", F.concat(F.lit("single_"), F.col(key).cast("string"))).select(*threads.columns)
    return threads.unionByName(found).unionByName(single)


def ordered(value: Column, order: Column) -> Column:
    """Aggregate: the group's values in order, nulls left out."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.transform(pairs, lambda x: x["v"])


def concat(value: Column, order: Column, separator: str = "\n", template: Callable[[Column], Column] | None = None) -> Column:
    """Aggregate: values joined in order (D10); with a template, empty ones are dropped and the rest put through it."""
    if template is None:
        return F.array_join(ordered(value.cast("string"), order), separator)
    return F.array_join(ordered(F.when(truthy(value.cast("string")), template(value)), order), separator)


def merge(arrays: Column, order: Column) -> Column:
    """Aggregate: arrays joined in order."""
    return F.flatten(ordered(arrays, order))


def first(value: Column, order: Column) -> Column:
    """Aggregate: the first value that is not null."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def last(value: Column, order: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), order))


def unique(value: Column, order: Column) -> Column:
    """Aggregate: distinct values in order of first appearance."""
    return F.array_distinct(ordered(value, order))


def parent_id(ids: Column, strategy: str = "first_child", template: Callable[[Column], Column] | None = None) -> Column:
    """A parent's source id from its children's, in order."""
    if strategy == "first_child":
        return F.concat(F.lit("parent-"), F.element_at(ids, 1))
    if strategy == "concatenate":
        return F.array_join(ids, "-")
    if strategy == "hash":
        return F.substring(F.sha2(F.array_join(ids, ","), 256), 1, 16)
    if strategy == "template" and template is not None:
        return template(ids)
    raise ValueError(f"unknown strategy {strategy!r}")


def build_parents(children: DataFrame, strategy: str = "first_child", separator: str = "\n", order: str = "ord") -> DataFrame:
    """A parent record for each group_id: ids, title, content, people, dates and child ids.

    ``children``: group_id, source_id, title, content, people, created_at, ord. Groups are threads or sessions and so
    bounded; longer ones should be cut before.
    """
    o = F.col(order)
    agg = children.groupBy("group_id").agg(
        ordered(F.col("source_id").cast("string"), o).alias("child_ids"),
        first(F.col("title"), o).alias("title"),
        concat(F.col("content"), o, separator).alias("content"),
        F.array_distinct(merge(F.col("people"), o)).alias("people"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("updated_at"),
        F.count("*").alias("n_children"),
    )
    return agg.withColumn("source_id", parent_id(F.col("child_ids"), strategy))


def union_extracts(children: DataFrame, order: str = "ord") -> DataFrame:
    """Entities of a group's children, the first of each type and id (D15); ``children``: group_id, ord, entities."""
    rows = children.select("group_id", order, F.posexplode("entities").alias("pos", "e"))
    w = Window.partitionBy("group_id", "e.type", "e.id").orderBy(order, "pos")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("group_id", "e.*")


def group_statistics(grouped: DataFrame, group: str = "group_id") -> DataFrame:
    """Number of groups and records and the mean size."""
    return grouped.groupBy(group).agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_size"))


def unlabelled(batch: pd.DataFrame) -> Iterator[int]:
    """A labeler that keeps a whole batch together."""
    return [0] * len(batch)
