"""Queries that map, route, extract, search and page raw records."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions import json as J
from kgspark.plans.registry import query
from kgspark.plans.tables import read
from kgspark.sources import tables as S
from kgspark.sources import transform as X
from kgspark.sources.config import from_dict


def raw(spark, sf_dir):
    """Customers as JSON of two kinds, and some that are neither."""
    k = F.col("c_custkey")
    doc = F.to_json(
        F.struct(
            F.when(k % 5 != 0, k.cast("string")).alias("id"),
            k.alias("cust_id"),
            F.struct(F.col("c_name").alias("name"), F.array(F.struct(F.lit("a").alias("tag")), F.struct(F.lower("c_mktsegment").alias("tag"))).alias("tags")).alias("info"),
            F.when(k % 3 == 0, "vip").when(k % 3 == 1, "plain").alias("kind"),
            (F.lit(1704067200) + k).alias("created"),
        )
    )
    return read(spark, sf_dir, "customer").select(k.alias("ord"), doc.alias("raw"))


CONFIG = from_dict(
    {
        "source": "crm",
        "record_types": [
            {"name": "vip", "condition": "record.kind === 'vip'", "id_field": "id", "fields": {"title": "info.name", "content": {"type": "template", "template": "${info.name} is ${kind}"}, "created_at": "created", "tags": "info.tags[0]"}},
            {"name": "plain", "condition": "record.kind", "fields": {"title": {"type": "paths", "paths": ["info.name", "missing", "kind"], "separator": " - "}, "content": "kind"}},
        ],
    }
)


@query("SELECT c_custkey AS ord, c_name AS name, 'a' AS first_tag, ['a', lower(c_mktsegment)] AS tags FROM customer")
def json_extract(spark, sf_dir):
    r = F.col("raw")
    return raw(spark, sf_dir).select("ord", J.value(r, "$.info.name").alias("name"), J.value(r, "info.tags[0].tag").alias("first_tag"), J.values(r, "$.info.tags[*].tag").alias("tags"))


@query("SELECT c_custkey AS ord, c_name || CASE c_custkey % 3 WHEN 0 THEN ' - vip' WHEN 1 THEN ' - plain' ELSE '' END AS text FROM customer")
def paths_join(spark, sf_dir):
    return raw(spark, sf_dir).select("ord", J.paths(F.col("raw"), ["info.name", "nothing", "kind"], " - ").alias("text"))


@query("SELECT c_custkey AS ord, c_name || ' <' || CASE c_custkey % 3 WHEN 0 THEN 'vip' WHEN 1 THEN 'plain' ELSE '' END || '>' AS text FROM customer")
def template_fill(spark, sf_dir):
    return raw(spark, sf_dir).select("ord", J.template(F.col("raw"), "${info.name} <${kind}>").alias("text"))


@query("SELECT c_custkey AS ord, CASE c_custkey % 3 WHEN 0 THEN 'vip' WHEN 1 THEN 'plain' END AS record_type FROM customer")
def route_record_type(spark, sf_dir):
    return raw(spark, sf_dir).select("ord", X.route(F.col("raw"), CONFIG.record_types).alias("record_type"))


@query(
    """SELECT c_custkey AS ord, 'crm_' || CASE c_custkey % 3 WHEN 0 THEN 'vip' ELSE 'plain' END || '_' || c_custkey AS _id, CASE c_custkey % 3 WHEN 0 THEN c_name ELSE c_name || ' - plain' END AS title,
CASE c_custkey % 3 WHEN 0 THEN c_name || ' is vip' ELSE 'plain' END AS content, CASE c_custkey % 3 WHEN 0 THEN 1704067200 + c_custkey END AS created_s,
sha256(CASE c_custkey % 3 WHEN 0 THEN c_name || chr(10) || c_name || ' is vip' ELSE c_name || ' - plain' || chr(10) || 'plain' END) AS checksum FROM customer WHERE c_custkey % 3 <> 2"""
)
def transform_records(spark, sf_dir):
    return X.transform(raw(spark, sf_dir), CONFIG).select("ord", "_id", "title", "content", F.unix_seconds("source_created_at").alias("created_s"), "checksum")


@query("SELECT c_custkey AS ord, 'no_record_type' AS reason FROM customer WHERE c_custkey % 3 = 2")
def quarantine(spark, sf_dir):
    return X.quarantine(raw(spark, sf_dir), CONFIG).select("ord", "reason")


@query("SELECT 'crm_vip_' || c_custkey AS _id, 'crm_tag_' || t AS id, t AS title FROM (SELECT c_custkey, unnest(['a', lower(c_mktsegment)]) AS t FROM customer WHERE c_custkey % 3 = 0)")
def explode_entities(spark, sf_dir):
    r = X.transform(raw(spark, sf_dir), CONFIG)
    return X.extract_entities(r, "crm", "Tag", "info.tags[*].tag", condition="kind == 'vip'").select("_id", "id", "title")


@query("SELECT 'crm_' || CASE c_custkey % 3 WHEN 0 THEN 'vip' ELSE 'plain' END || '_' || c_custkey AS src, 'TAGGED' AS type, 'crm_tag_' || t AS dst, 1.0::DOUBLE AS confidence FROM (SELECT c_custkey, unnest(['a', lower(c_mktsegment)]) AS t FROM customer WHERE c_custkey % 3 <> 2)")
def explode_relationships(spark, sf_dir):
    r = X.transform(raw(spark, sf_dir), CONFIG)
    return X.extract_relationships(r, "crm", "TAGGED", "Tag", "info.tags[*].tag")


@query("SELECT n_regionkey AS region, n_nationkey AS nation FROM nation")
def unwrap_pages(spark, sf_dir):
    page = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region")))).alias("results")))
    pages = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("ord")).agg(page.alias("raw"))
    rows = X.unwrap(pages)
    return rows.select(J.value(F.col("raw"), "region").cast("int").alias("region"), J.value(F.col("raw"), "id").cast("int").alias("nation"))


@query("SELECT doc_id, lang, source, total FROM (SELECT *, count(*) OVER () AS total FROM documents WHERE source = 'src4') ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 10")
def pr_search(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("state"), F.col("source").alias("author"), F.col("n_chars").alias("created_at"), F.col("text").alias("title"), F.lit(None).cast("string").alias("body"), F.array("lang").alias("labels"))
    return S.search_pulls(d, "author:src4", page=2, size=10).select(F.col("id").alias("doc_id"), F.col("state").alias("lang"), F.col("author").alias("source"), "total")


@query("SELECT doc_id, source FROM documents WHERE doc_id > 57 ORDER BY doc_id LIMIT 25")
def keyset_page(spark, sf_dir):
    return S.keyset_page(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 57, 25)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30 OFFSET 60")
def offset_page(spark, sf_dir):
    return S.offset_page(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 3)


@query("SELECT o_custkey, max_by(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS o_orderkey FROM orders GROUP BY 1")
def latest_release(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return S.latest(o, ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey")


@query("SELECT 'nation' AS kind, n_name AS name FROM nation WHERE contains(lower(n_name), '1') UNION ALL SELECT 'region', r_name FROM region WHERE contains(lower(r_name), '1')")
def object_search(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.lit("nation").alias("kind"), F.col("n_name").alias("name"))
    r = read(spark, sf_dir, "region").select(F.lit("region").alias("kind"), F.col("r_name").alias("name"))
    return S.search_objects([n, r], "1", 1000)


@query("SELECT CAST(floor(n_nationkey / 10) AS BIGINT) AS batch, list(n_name ORDER BY n_nationkey) AS \"values\" FROM nation GROUP BY 1")
def value_batches(spark, sf_dir):
    return S.batches(read(spark, sf_dir, "nation"), "n_name", 10, "n_nationkey")


@query("SELECT c_custkey, n_name, coalesce(n, 0) AS orders FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def enrich_and_aggregate(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("ord"), "o_totalprice")
    rows = X.aggregate_children(X.enrich(read(spark, sf_dir, "customer"), n, "c_nationkey", "nation"), o, "c_custkey", "orders")
    return rows.select("c_custkey", F.col("nation.n_name").alias("n_name"), F.greatest(F.coalesce(F.size("orders"), F.lit(0)), F.lit(0)).cast("long").alias("orders"))


@query("SELECT o_orderkey, o_orderkey * 2 AS a, 'x' || o_custkey AS b FROM orders")
def csv_to_rows(spark, sf_dir):
    text = F.concat(F.lit("a,b\n"), (F.col("o_orderkey") * 2).cast("string"), F.lit(" , x"), F.col("o_custkey").cast("string"), F.lit("\n\n"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.explode(S.csv_rows(text, "a bigint, b string")).alias("r"))
    return rows.select("o_orderkey", "r.a", "r.b")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(json_extract(props, '$.k') AS INT) > 50 AS large FROM events")
def json_condition(spark, sf_dir):
    p = F.col("props")
    return read(spark, sf_dir, "events").select("event_id", J.value(p, "k").cast("int").alias("k"), J.condition(p, "record.k > 50 && !missing").alias("large"))
