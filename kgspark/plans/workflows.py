"""Queries over workflows, the type registry, discovery and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.operators import extraction as E
from kgspark.operators import order as O
from kgspark.operators import registry as R
from kgspark.operators import workflows as W
from kgspark.plans.graph import _UUID
from kgspark.plans.ingest import CONFIG, raw
from kgspark.plans.registry import query
from kgspark.plans.tables import GRAPH, RECORDS, edges, nodes, read, records
from kgspark.sources import discovery as D


def _messages(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select(F.concat_ws(".", "conv_id", F.lpad(F.col("turn").cast("string"), 4, "0")).alias("ts"), F.when(F.col("turn") > 0, F.concat(F.col("conv_id").cast("string"), F.lit(".0000"))).alias("thread_ts"), F.lit("c").alias("channel"), F.col("role").alias("user"), "text")


def _owners(spark):
    return spark.createDataFrame([("m1", 1, 1, "the"), ("m2", 1, 2, "of"), ("p1", 2, 1, " and "), ("p2", 2, 2, "")], "owner string, phase int, ord int, phrase string")


_THREADS = "m AS (SELECT conv_id || '.0000' AS thread_id, conv_id || '.' || lpad(turn::VARCHAR, 4, '0') AS ts, turn, role, text FROM conversations)"


@query(f"WITH {_THREADS} SELECT thread_id, count(*) FILTER (turn > 0) AS replies, count(*) AS messages, list(DISTINCT role ORDER BY role) AS participants, min_by(text, turn) AS parent_text FROM m GROUP BY 1")
def message_threads(spark, sf_dir):
    return W.threads(_messages(spark, sf_dir)).select("thread_id", "replies", "messages", "participants", "parent_text")


_CLAIMS = f"""{_THREADS}, claims AS (SELECT thread_id, CASE WHEN bool_or(contains(text, 'the')) THEN 'm1' WHEN bool_or(contains(text, 'of')) THEN 'm2' WHEN bool_or(contains(text, ' and ')) THEN 'p1' END AS owner FROM m GROUP BY 1)"""


@query(f"WITH {_CLAIMS} SELECT thread_id, owner FROM claims WHERE owner IS NOT NULL")
def claimed_threads(spark, sf_dir):
    return W.claim_threads(_owners(spark), _messages(spark, sf_dir))


@query(
    f"""WITH {_CLAIMS} SELECT owner, count(DISTINCT thread_id) AS cross_references, 1 + count(DISTINCT thread_id) AS total_records, count(*) AS total_messages, CAST(count(DISTINCT role) AS INT) AS participants
FROM claims JOIN m USING (thread_id) WHERE owner IS NOT NULL GROUP BY 1"""
)
def workflow_groups(spark, sf_dir):
    return W.workflows(_owners(spark), _messages(spark, sf_dir)).select("owner", "cross_references", "total_records", "total_messages", "participants")


@query(f"WITH {GRAPH} SELECT type AS name, list(DISTINCT s.label ORDER BY s.label) AS source_types, list(DISTINCT d.label ORDER BY d.label) AS target_types FROM edges JOIN nodes s ON s.id = src JOIN nodes d ON d.id = dst GROUP BY 1")
def discovered_types(spark, sf_dir):
    return R.discovered(nodes(spark, sf_dir), edges(spark, sf_dir))[1].select("name", "source_types", "target_types")


@query("SELECT CASE c_custkey % 3 WHEN 0 THEN 'vip' WHEN 1 THEN 'plain' END AS record_type, count(*) AS n, count(CASE WHEN c_custkey % 3 <> 2 THEN 1 END) AS with_id FROM customer GROUP BY 1")
def config_dry_run(spark, sf_dir):
    return D.dry_run(raw(spark, sf_dir), CONFIG)


@query("SELECT c_custkey AS ord, 'cust_id' AS field, CAST(c_custkey AS VARCHAR) AS value FROM customer UNION ALL SELECT c_custkey, 'id', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 5 <> 0")
def discover_ids(spark, sf_dir):
    return raw(spark, sf_dir).select("ord", F.explode(D.discover_ids("raw")).alias("x")).select("ord", "x.field", "x.value")


@query("SELECT o_orderkey, sha256('{\"a\":[1,' || o_orderkey + 1 || '],\"b\":\"x\"}') AS checksum FROM orders")
def canonical_checksum(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat(F.lit('{"b": "x", "updated_at": "'), k.cast("string"), F.lit('", "a": ['), (k + 1).cast("string"), F.lit(", 1]}"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.sha2(D.canonical_json(text), 256).alias("checksum"))


#: What the stand-in extractor knows; words that texts of every table size hold together.
_NAMES = {"thtion": "Person", "erble": "Project", "oning": "Topic"}
_FOUND = f"""{RECORDS}, names(name, type) AS (VALUES {", ".join(f"('{n}', '{t}')" for n, t in _NAMES.items())}),
found AS (SELECT _id, name, type, strpos(content, name) AS place FROM records JOIN names ON contains(content, name))"""


@query(f"WITH {_FOUND} SELECT _id AS record_id, checksum, CASE WHEN _id IN (SELECT _id FROM found) THEN 'success' ELSE 'empty' END AS status FROM records WHERE coalesce(trim(content), '') <> ''")
def graph_indexing(spark, sf_dir):
    """Statuses of all records with the stand-in extractor."""
    return E.index_graph(records(spark, sf_dir), E.dictionary_extractor(_NAMES))["status"]


@query(
    f"""WITH {_FOUND}, pairs AS (SELECT name AS source, lead(name) OVER (PARTITION BY _id ORDER BY place, name) AS target FROM found),
ids AS (SELECT name, {_UUID} AS id FROM (SELECT name, sha256(type || ':' || name) AS h FROM names))
SELECT DISTINCT s.id AS src, d.id AS dst, 'NEXT_TO' AS type, 0.7::DOUBLE AS confidence FROM pairs JOIN ids s ON s.name = source JOIN ids d ON d.name = target"""
)
def graph_from_text(spark, sf_dir):
    """Edges that the stand-in extractor finds in all records."""
    return E.index_graph(records(spark, sf_dir), E.dictionary_extractor(_NAMES))["edges"].select("src", "dst", "type", "confidence")


@query("SELECT count(*) AS n, count(*) AS places, CAST(0 AS BIGINT) AS low, count(*) - 1 AS high, CAST(sum(o_orderkey) AS BIGINT) AS keys, true AS moved FROM orders")
def shuffled_rows(spark, sf_dir):
    """Rows put in a random order by a keyed permutation of their numbers (F15): every place is taken once."""
    s = O.shuffled(read(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 7)
    # In order of keys, about half of the places are smaller than the one before; a sorted or turned list has none or all.
    odd = s.where("place % 2 = 0").agg(F.corr("place", "o_orderkey").alias("c"))
    return s.agg(F.count("*").alias("n"), F.countDistinct("place").alias("places"), F.min("place").alias("low"), F.max("place").alias("high"), F.sum("o_orderkey").alias("keys")).join(odd.select((F.abs("c") < 0.2).alias("moved")))


@query("SELECT l_linestatus, count(*) // 1 AS n, true AS sampled FROM (SELECT DISTINCT l_linestatus FROM lineitem) GROUP BY 1")
def sampled_rows(spark, sf_dir):
    """A tenth of the rows of each status, drawn without replacement (F15): within a tenth of its share."""
    i = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    s = O.sample(i, ["l_orderkey", "l_linenumber"], 0.1, 3)
    shares = i.groupBy("l_linestatus").agg(F.count("*").alias("all")).join(s.groupBy("l_linestatus").agg(F.count("*").alias("drawn")), "l_linestatus")
    return shares.select("l_linestatus", F.lit(1).cast("long").alias("n"), (F.abs(F.col("drawn") / F.col("all") - 0.1) < 0.02).alias("sampled"))


@query("SELECT CAST(100 AS BIGINT) AS n, CAST(100 AS BIGINT) AS keys, true AS heavy")
def weighted_rows(spark, sf_dir):
    """A hundred rows picked by weight (F15): none twice, and heavier than the table's rows are on average."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    drawn = W.weighted_pick(o, "o_totalprice", 100, "o_orderkey", 5)
    return drawn.agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("keys"), F.avg("o_totalprice").alias("m")).join(o.agg(F.avg("o_totalprice").alias("a"))).select("n", "keys", (F.col("m") > F.col("a")).alias("heavy"))


@query("SELECT o_orderkey, o_totalprice, n FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS n FROM orders) WHERE n >= 700 AND n < 760")
def deep_page(spark, sf_dir):
    """A page far down an order of two keys, read from the ranges that hold it."""
    index = O.order_index(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 256)
    return index.page(700, 60).withColumnRenamed("_n", "n")
