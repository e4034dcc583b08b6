"""Queries that group records."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.operators import grouping as G
from kgspark.plans.registry import query
from kgspark.plans.tables import messages, read


@query("SELECT CAST(conv_id AS VARCHAR) AS group_id, count(*) AS n FROM conversations WHERE turn > 0 GROUP BY 1")
def thread_groups(spark, sf_dir):
    m = messages(spark, sf_dir)
    return G.thread_groups(m, F.when(F.col("turn") > 0, F.col("thread"))).groupBy("group_id").agg(F.count("*").alias("n"))


@query("SELECT CAST(conv_id AS VARCHAR) AS group_id, count(*) AS n FROM conversations WHERE turn > 0 OR conv_id % 2 = 0 GROUP BY 1")
def thread_groups_with_parents(spark, sf_dir):
    m = messages(spark, sf_dir)
    return G.thread_groups(m, F.when(F.col("turn") > 0, F.col("thread")), F.col("thread") % 2 == 0, F.col("thread")).groupBy("group_id").agg(F.count("*").alias("n"))


@query(
    """SELECT CAST(conv_id AS VARCHAR) AS group_id, 'parent-' || min_by(conv_id || '-' || turn, turn) AS source_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS content_sha,
list(conv_id || '-' || turn ORDER BY turn) AS child_ids, min_by(role, turn) AS title, count(*) AS n_children FROM conversations GROUP BY conv_id"""
)
def thread_parents(spark, sf_dir):
    m = messages(spark, sf_dir).select(
        F.col("thread").cast("string").alias("group_id"), "source_id", F.col("role").alias("title"), F.col("text").alias("content"), F.array("role").alias("people"), F.col("turn").alias("created_at"), F.col("turn").alias("ord")
    )
    return G.build_parents(m).select("group_id", "source_id", F.sha2("content", 256).alias("content_sha"), "child_ids", "title", "n_children")


@query(
    """WITH o AS (SELECT conv_id, role, turn, min(turn) OVER (PARTITION BY conv_id, role) AS f FROM conversations),
r AS (SELECT conv_id, list(role ORDER BY f) AS roles FROM (SELECT DISTINCT conv_id, role, f FROM o) GROUP BY 1)
SELECT conv_id AS thread, any_value(roles) AS roles, min_by(role, turn) AS first_role, max_by(role, turn) AS last_role, substr(sha256(string_agg(conv_id || '-' || turn, ',' ORDER BY turn)), 1, 16) AS hash_id
FROM conversations JOIN r USING (conv_id) GROUP BY 1"""
)
def parent_aggregates(spark, sf_dir):
    o = F.col("turn")
    m = messages(spark, sf_dir).groupBy("thread").agg(
        G.unique(F.col("role"), o).alias("roles"), G.first(F.col("role"), o).alias("first_role"), G.last(F.col("role"), o).alias("last_role"), G.ordered(F.col("source_id"), o).alias("ids")
    )
    return m.select("thread", "roles", "first_role", "last_role", G.parent_id(F.col("ids"), "hash").alias("hash_id"))


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").withColumns({"ord": F.col("event_id"), "s": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6})


@query(
    """WITH e AS (SELECT *, epoch(ts) AS s, lag(epoch(ts)) OVER w AS p FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR s - p > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS session FROM e)
SELECT user_id, CAST(session AS BIGINT) AS session, round(min(s), 3) AS start, count(*) AS n FROM g GROUP BY 1, 2"""
)
def user_sessions(spark, sf_dir):
    s = G.user_sessions(_events(spark, sf_dir), "user_id", F.col("s"))
    return s.groupBy("user_id", "session").agg(F.round(F.min("session_start"), 3).alias("start"), F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT *, epoch(ts) AS s, lag(epoch(ts)) OVER w AS p, lag(event_type) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR s - p > 86400 OR event_type IS DISTINCT FROM c THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS session FROM e),
x AS (SELECT user_id, session, min(s) AS start, count(*) AS n FROM g GROUP BY 1, 2)
SELECT user_id, CAST(session AS BIGINT) AS session, n, row_number() OVER (ORDER BY first, user_id, session) - 1 AS number FROM (SELECT *, min(start) OVER (PARTITION BY user_id) AS first FROM x)"""
)
def user_sessions_with_context(spark, sf_dir):
    s = G.user_sessions(_events(spark, sf_dir), "user_id", F.col("s"), "event_type", 86400)
    return G.number_sessions(s, "user_id").select("user_id", "session", "n", F.col("number").cast("long").alias("number"))


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id % 16 AS page, event_type, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT *, s AS st FROM e WHERE n = 1 UNION ALL
  SELECT e.*, CASE WHEN e.s - f.st > 3600 OR e.event_type IS DISTINCT FROM f.event_type THEN e.s ELSE f.st END FROM f JOIN e ON e.page = f.page AND e.n = f.n + 1)
SELECT event_id, page, round(st, 3) AS group_start FROM f"""
)
def time_window_groups(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", (F.col("user_id") % 16).alias("page"), "event_type", "s", "ord")
    return G.time_windows(e, F.col("s"), 3600, "page", ["event_type"]).select("event_id", "page", F.round("group_start", 3).alias("group_start"))


@query("SELECT conv_id, turn FROM conversations QUALIFY count(*) OVER (PARTITION BY conv_id) >= 4")
def min_group_size(spark, sf_dir):
    return G.least_size(messages(spark, sf_dir), 4, "thread").select(F.col("thread").alias("conv_id"), "turn")


@query("SELECT event_id, b AS batch, event_id - b * 40 AS place FROM (SELECT event_id, unnest(range(greatest(CAST(ceil((event_id - 49) / 40.0) AS BIGINT), 0), CAST(floor(event_id / 40.0) AS BIGINT) + 1)) AS b FROM events)")
def overlap_batches(spark, sf_dir):
    return G.overlap_batches(read(spark, sf_dir, "events").select("event_id"), order="event_id").select("event_id", "batch", "place")


@query(
    """WITH t AS (SELECT *, conv_id * 1000 + turn AS ord, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE conv_id % 3 <> 0),
rest AS (SELECT *, conv_id * 1000 + turn AS ord FROM conversations WHERE conv_id % 3 = 0 OR conv_id IN (SELECT conv_id FROM t WHERE n < 2)),
r AS (SELECT *, count(*) OVER (PARTITION BY role) AS n FROM rest)
SELECT ord, CAST(conv_id AS VARCHAR) AS group_id FROM t WHERE n >= 2 UNION ALL SELECT ord, CASE WHEN n >= 2 THEN role ELSE 'single_' || ord END FROM r"""
)
def hybrid_groups(spark, sf_dir):
    m = messages(spark, sf_dir)
    by_role = lambda rows: rows.withColumn("group_id", F.col("role"))
    return G.hybrid_groups(m, F.when(F.col("thread") % 3 != 0, F.col("thread")), by_role).select("ord", "group_id")


@query("SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS records, avg(n) AS mean_size FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)")
def group_statistics(spark, sf_dir):
    return G.group_statistics(messages(spark, sf_dir), "thread")


@query("SELECT n_regionkey AS group_id, CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS type, s_nationkey AS id, min(s_suppkey) AS first FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL")
def union_extracts(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("group_id"))
    kind = F.when(F.col("s_suppkey") % 2 == 0, "A").otherwise("B")
    c = read(spark, sf_dir, "supplier").join(n, "s_nationkey").select("group_id", F.col("s_suppkey").alias("ord"), F.array(F.struct(kind.alias("type"), F.col("s_nationkey").alias("id"), F.col("s_suppkey").alias("first"))).alias("entities"))
    return G.union_extracts(c)
