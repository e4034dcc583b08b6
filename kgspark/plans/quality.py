"""Queries that judge results and sum up runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions import text as T
from kgspark.operators import metrics as M
from kgspark.plans.registry import query
from kgspark.plans.tables import read

_JUDGED = """
retrieved AS (SELECT lang AS query, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS pos FROM documents QUALIFY pos <= 50),
relevant AS (SELECT lang AS query, doc_id AS id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
m AS (SELECT query, count(*) AS m FROM relevant GROUP BY 1),
j AS (SELECT r.*, CASE WHEN v.id IS NULL THEN 0 ELSE 1 END AS rel FROM retrieved r LEFT JOIN relevant v USING (query, id))
"""


def _judged(spark, sf_dir):
    from pyspark.sql import Window

    d = read(spark, sf_dir, "documents")
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    got = d.select(F.col("lang").alias("query"), F.col("doc_id").alias("id"), F.row_number().over(w).alias("pos")).where("pos <= 50")
    want = d.join(read(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select(F.col("lang").alias("query"), F.col("doc_id").alias("id"))
    return got, want


@query(
    "SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std_dev, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, min(value) AS min, max(value) AS max, round(sum(value), 4) AS sum, count(value) AS n FROM events GROUP BY 1"
)
def summary_stats(spark, sf_dir):
    s = M.summary(read(spark, sf_dir, "events"), "value", ["event_type"])
    return s.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std_dev")], "p95", "p99", "min", "max", F.round("sum", 4).alias("sum"), "n")


@query(
    "SELECT user_id % 3 AS g, round(median(value), 6) AS median, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, count(value) AS n FROM events GROUP BY 1 UNION ALL "
    "SELECT -1, round(median(value), 6), quantile_disc(value, 0.95), quantile_disc(value, 0.99), count(value) FROM events"
)
def summary_of_hot_groups(spark, sf_dir):
    """Exact ranks of a group that holds all rows and of smaller ones, by narrowed ranges."""
    e = read(spark, sf_dir, "events").select("value", F.explode(F.array(F.lit(-1).cast("long"), F.col("user_id") % 3)).alias("g"))
    return M.summary(e, "value", ["g"], most=200).select("g", F.round("median", 6).alias("median"), "p95", "p99", "n")


@query("SELECT quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events")
def percentile_nearest(spark, sf_dir):
    return M.summary(read(spark, sf_dir, "events"), "value").select("p95", "p99")


@query(f"WITH {_JUDGED}, x AS (SELECT query, sum(rel) / count(*)::DOUBLE AS p, sum(rel) / any_value(m)::DOUBLE AS r FROM j JOIN m USING (query) GROUP BY 1) SELECT query, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1 FROM x")
def precision_recall(spark, sf_dir):
    return M.precision_recall(*_judged(spark, sf_dir)).select("query", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_JUDGED}, i AS (SELECT query, list_sum([1 / log2(k + 1) for k in range(1, m + 1)]) AS ideal FROM m) SELECT query, round(1.0 / min(CASE WHEN rel = 1 THEN pos END), 9) AS mrr, round(sum(CASE WHEN rel = 1 THEN 1 / log2(pos + 1) ELSE 0 END) / any_value(ideal), 9) AS ndcg FROM j JOIN i USING (query) GROUP BY 1")
def mrr_ndcg(spark, sf_dir):
    return M.mrr_ndcg(*_judged(spark, sf_dir)).select("query", F.round("mrr", 9).alias("mrr"), F.round("ndcg", 9).alias("ndcg"))


@query(
    f"""WITH {_JUDGED}, s AS (SELECT *, sum(rel) OVER (PARTITION BY query ORDER BY pos) AS seen FROM j),
ap AS (SELECT query, sum(CASE WHEN rel = 1 THEN seen / pos::DOUBLE ELSE 0 END) / any_value(m) AS ap, max(CASE WHEN pos <= 10 THEN rel ELSE 0 END) AS hit, sum(CASE WHEN pos <= 10 THEN rel ELSE 0 END) / any_value(m)::DOUBLE AS cov FROM s JOIN m USING (query) GROUP BY 1)
SELECT round(avg(ap), 9) AS map, avg(hit) AS hit_rate, round(avg(cov), 9) AS coverage FROM ap"""
)
def map_hit_coverage(spark, sf_dir):
    r = M.rates_at(*_judged(spark, sf_dir), 10)
    return r.select(F.round("map", 9).alias("map"), "hit_rate", F.round("coverage", 9).alias("coverage"))


@query("SELECT event_type, count(*) FILTER (v > 0.8) AS high, count(*) FILTER (v >= 0.6 AND v <= 0.8) AS medium, count(*) FILTER (v < 0.6) AS low, round(avg(v), 9) AS mean_score FROM (SELECT event_type, (event_id % 100) / 100.0::DOUBLE AS v FROM events) GROUP BY 1")
def score_histogram(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 100 / 100.0).alias("score"))
    return M.score_histogram(e, ["event_type"]).withColumn("mean_score", F.round("mean_score", 9))


@query(f"WITH {_JUDGED} SELECT query, round(count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) / count(*)::DOUBLE, 9) AS jaccard FROM retrieved a FULL JOIN relevant b USING (query, id) GROUP BY 1")
def jaccard(spark, sf_dir):
    return M.jaccard(*_judged(spark, sf_dir)).withColumn("jaccard", F.round("jaccard", 9))


_NORM = r"trim(regexp_replace(regexp_replace(lower({}), '[.,;:!?()\[\]{{}}''\"]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(
    f"""WITH d AS (SELECT doc_id, {_NORM.format("text")} AS r FROM documents), b AS (SELECT item_id, {_NORM.format("text")} AS i FROM benchmark),
w AS (SELECT *, list_filter(string_split(i, ' '), lambda x: length(x) > 2) AS ws FROM b)
SELECT doc_id, item_id FROM d, w WHERE contains(r, i) OR (len(ws) > 0 AND len(list_filter(ws, lambda x: list_contains(string_split(r, ' '), x))) >= 0.7 * len(ws))"""
)
def must_include(spark, sf_dir):
    return M.matched_items(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


def _runs(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("agent"), F.when(F.col("o_orderkey") % 2 == 0, "base").otherwise("fast").alias("setup"), F.col("o_totalprice").alias("time"), (F.col("o_orderkey") % 100).alias("tokens"), (F.col("o_custkey") % 7 / 100.0).alias("cost"))


_RUNS = """r AS (SELECT o_orderpriority AS agent, CASE WHEN o_orderkey % 2 = 0 THEN 'base' ELSE 'fast' END AS setup, o_totalprice AS time, o_orderkey % 100 AS tokens, (o_custkey % 7) / 100.0::DOUBLE AS cost FROM orders),
c AS (SELECT agent, setup, floor(avg(time) + 0.5) AS time, floor(avg(tokens) + 0.5) AS tokens, avg(cost) AS cost, count(*) AS n FROM r GROUP BY 1, 2)"""


@query(
    f"""WITH {_RUNS} SELECT b.agent, round(b.time / o.time, 9) AS speedup, round((b.tokens - o.tokens) / b.tokens * 100, 9) AS token_savings, round((b.cost - o.cost) / b.cost * 100, 6) AS cost_savings,
CASE WHEN b.time + 1000 * b.cost <= o.time + 1000 * o.cost THEN 'base' ELSE 'fast' END AS best FROM c b JOIN c o ON b.agent = o.agent AND b.setup = 'base' AND o.setup = 'fast'"""
)
def matrix_analysis(spark, sf_dir):
    m = M.matrix_analysis(_runs(spark, sf_dir), "base", "fast")
    return m.select("agent", F.round("speedup", 9).alias("speedup"), F.round("token_savings", 9).alias("token_savings"), F.round("cost_savings", 6).alias("cost_savings"), "best")


@query("SELECT agent, scenario, setup, iteration FROM (SELECT n_name AS agent FROM nation), (SELECT r_name AS scenario FROM region), (SELECT unnest(['base', 'fast']) AS setup), (SELECT unnest([1, 2, 3]) AS iteration)")
def scenario_matrix(spark, sf_dir):
    return M.scenario_matrix(read(spark, sf_dir, "nation").select(F.col("n_name").alias("agent")), read(spark, sf_dir, "region").select(F.col("r_name").alias("scenario")), ["base", "fast"], 3)


@query("SELECT conv_id, role, count(*) AS n, count(*) - 1 AS replies, min(turn) AS first, max(turn) AS last, count(DISTINCT text) AS texts FROM conversations GROUP BY 1, 2")
def thread_rollup(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.groupBy("conv_id", "role").agg(F.count("*").alias("n"), (F.count("*") - 1).alias("replies"), F.min("turn").alias("first"), F.max("turn").alias("last"), F.countDistinct("text").alias("texts"))
