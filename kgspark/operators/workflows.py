"""Workflows: issues, pulls, meetings and pages with the threads that discuss them.

Messages: ts, thread_ts, channel, user, text. A thread belongs to the first owner, in the order of phases and of
owners in a phase, that it mentions; an owner without threads makes no workflow unless it has other references.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import ISSUE_REFERENCE, references
from kgspark.operators.phrases import match


def threads(messages: DataFrame) -> DataFrame:
    """A row a thread (D32): its channel, parent's text, number of replies and messages, participants."""
    m = messages.withColumn("thread_id", F.coalesce(F.nullif("thread_ts", F.lit("")), "ts")).where(F.col("thread_id").isNotNull())
    reply = F.col("thread_ts").isNotNull() & (F.col("thread_ts") != F.col("ts"))
    return m.groupBy("thread_id").agg(
        F.min_by("channel", "ts").alias("channel"),
        F.min_by("text", F.struct(F.when(reply, 1).otherwise(0), F.col("ts"))).alias("parent_text"),
        F.count_if(reply).alias("replies"),
        F.count("*").alias("messages"),
        F.array_sort(F.collect_set("user")).alias("participants"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def issue_references(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Issues that texts name as #n (C20): key, issue; an equi-join away from the issues."""
    return rows.select(key, F.explode(references(F.col(text), ISSUE_REFERENCE)).alias("issue")).distinct()


def claim_threads(owners: DataFrame, messages: DataFrame) -> DataFrame:
    """Threads by the first owner that one of their messages mentions (C21): thread_id, owner.

    ``owners``: owner, phase, ord, phrase; a stated list of meetings and pages, searched for in one pass over the
    messages. Greedy claiming in order gives each thread to its first match, which is the least (phase, ord), so no
    loop is needed.
    """
    m = messages.select(F.coalesce(F.nullif("thread_ts", F.lit("")), "ts").alias("thread_id"), "text")
    hits = match(m, "thread_id", "text", owners.where(F.length("phrase") > 0), "owner", "phrase").distinct()
    return hits.join(owners.select("owner", "phase", "ord"), "owner").groupBy("thread_id").agg(F.min_by("owner", F.struct("phase", "ord")).alias("owner"))


def workflows(owners: DataFrame, messages: DataFrame) -> DataFrame:
    """Workflows of owners and their threads, the most connected first."""
    claimed = claim_threads(owners, messages).join(threads(messages), "thread_id")
    w = claimed.groupBy("owner").agg(
        F.count("*").alias("cross_references"),
        (1 + F.count("*")).alias("total_records"),
        F.sum("messages").alias("total_messages"),
        F.size(F.array_distinct(F.flatten(F.collect_list("participants")))).alias("participants"),
        F.min("first_ts").alias("start"),
        F.max("last_ts").alias("end"),
    )
    return w.join(owners.select("owner", "phrase"), "owner").withColumnRenamed("phrase", "title").orderBy(F.desc("cross_references"), "owner")


WORK = ["standup", "planning", "review", "sprint"]


def work_context(meetings: DataFrame, details: DataFrame, words: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Meetings whose title holds one of some words, and the details recorded of them."""
    pattern = "|".join(words or WORK)
    chosen = meetings.where(F.lower("title").rlike(pattern))
    return chosen, details.join(chosen.select("recording_id"), "recording_id", "left_semi")


def combine(parts: list[DataFrame]) -> DataFrame:
    """Stages' rows together, missing columns null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def weighted_pick(rows: DataFrame, weight: str, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows drawn without replacement by weight (F15): the largest of u ** (1 / weight), u from the key's hash."""
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    return rows.where(F.col(weight) > 0).withColumn("_d", F.ln(u) / F.col(weight)).orderBy(F.desc("_d"), key).limit(n).drop("_d")


