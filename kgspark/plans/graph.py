"""Queries over the graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions import ids as I
from kgspark.functions import text as T
from kgspark.operators import graph as G
from kgspark.plans.registry import query
from kgspark.plans.tables import EXTRACTED, GRAPH, edges, extracted, nodes

_ANCHORS = "('n1', 'n2', 'c5', 'c6', 'r0')"


def _anchors(spark):
    return spark.createDataFrame([(x,) for x in ("n1", "n2", "c5", "c6", "r0")], "id string")


@query(
    f"WITH {GRAPH} SELECT src, type, dst, src AS anchor, dst AS other FROM edges WHERE src IN {_ANCHORS} UNION ALL SELECT src, type, dst, dst, src FROM edges WHERE dst IN {_ANCHORS} AND src <> dst"
)
def one_hop_both(spark, sf_dir):
    return G.one_hop(edges(spark, sf_dir), _anchors(spark)).select("src", "type", "dst", "anchor", "other")


@query(f"WITH {GRAPH} SELECT src, type, dst, src AS anchor, dst AS other FROM edges WHERE src IN {_ANCHORS} AND type = 'LOCATED_IN'")
def one_hop_typed_out(spark, sf_dir):
    return G.one_hop(edges(spark, sf_dir), _anchors(spark), "out", ["LOCATED_IN"]).select("src", "type", "dst", "anchor", "other")


@query(f"WITH {GRAPH} SELECT id, count(e.src) AS degree, CAST(least(floor(count(e.src) / 10.0 * 100 + 0.5), 100) AS BIGINT) AS rank FROM nodes LEFT JOIN edges e ON e.src = id GROUP BY id")
def node_degree(spark, sf_dir):
    return G.degree(nodes(spark, sf_dir), edges(spark, sf_dir)).select("id", "degree", G.node_rank(F.col("degree")).alias("rank"))


@query(f"WITH {GRAPH}, chosen AS (SELECT id FROM nodes WHERE label <> 'Customer') SELECT src, type, dst, confidence FROM edges WHERE src IN (SELECT id FROM chosen) AND dst IN (SELECT id FROM chosen)")
def induced_subgraph(spark, sf_dir):
    return G.induced(edges(spark, sf_dir), nodes(spark, sf_dir).where("label <> 'Customer'")).select("src", "type", "dst", "confidence")


@query(f"WITH {GRAPH}, p AS (SELECT * FROM nodes ORDER BY id LIMIT 40 OFFSET 20) SELECT id, label, (SELECT count(*) FROM edges WHERE src IN (SELECT id FROM p) AND dst IN (SELECT id FROM p)) AS edges_in_page FROM p")
def graph_page(spark, sf_dir):
    some, among = G.page(nodes(spark, sf_dir), edges(spark, sf_dir), 20, 40)
    return some.select("id", "label").join(F.broadcast(among.agg(F.count("*").alias("edges_in_page"))))


_PATHS = """
WITH RECURSIVE """ + GRAPH.strip() + """, base AS (SELECT src, type, dst FROM edges),
step AS (SELECT src AS a, dst AS b, src || '|' || type || '|' || dst AS e FROM base UNION SELECT dst, src, src || '|' || type || '|' || dst FROM base WHERE src <> dst),
walk AS (SELECT [a, b] AS n, [e] AS es, b AS last FROM step WHERE a = 'n1' UNION ALL SELECT list_append(n, b), list_append(es, e), b FROM walk JOIN step ON a = last WHERE NOT list_contains(es, e) AND len(es) < 4)
SELECT array_to_string(n, '>') AS path, CAST(len(es) AS INT) AS depth FROM walk WHERE last = 'n6' ORDER BY depth, path LIMIT 10
"""


@query(_PATHS)
def paths_bounded(spark, sf_dir):
    return G.paths(edges(spark, sf_dir), "n1", "n6", 4).select(F.array_join("nodes", ">").alias("path"), "depth")


@query(f"WITH {GRAPH} SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM edges WHERE type = 'PLACED_BY' UNION SELECT dst FROM edges WHERE type = 'PLACED_BY')")
def orphan_nodes(spark, sf_dir):
    return G.orphan_nodes(nodes(spark, sf_dir), edges(spark, sf_dir).where("type = 'PLACED_BY'")).select("id")


def _mentions(spark, sf_dir):
    return edges(spark, sf_dir).where("confidence > 0.3").select("src", "type", "dst", F.concat(F.lit("d"), F.length("src").cast("string")).alias("record_id"))


@query(f"WITH {GRAPH} SELECT src, type, dst FROM edges EXCEPT ALL SELECT src, type, dst FROM edges WHERE confidence > 0.3")
def orphan_edges(spark, sf_dir):
    return G.orphan_edges(edges(spark, sf_dir), _mentions(spark, sf_dir)).select("src", "type", "dst")


@query(f"WITH {GRAPH}, gone AS (SELECT src, type, dst FROM edges WHERE confidence > 0.3 AND length(src) = 3) SELECT type, count(*) AS n FROM edges e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.src = e.src AND g.type = e.type AND g.dst = e.dst) GROUP BY type")
def document_cleanup(spark, sf_dir):
    ids = spark.createDataFrame([("d3",)], "record_id string")
    return G.edges_by_type(G.remove_document(nodes(spark, sf_dir), edges(spark, sf_dir), _mentions(spark, sf_dir), ids)[1])


@query(f"WITH {GRAPH} SELECT type, count(*) AS n FROM edges GROUP BY type")
def edges_by_type(spark, sf_dir):
    return G.edges_by_type(edges(spark, sf_dir))


@query(f"WITH {GRAPH} SELECT label, count(*) AS n FROM nodes GROUP BY label")
def nodes_by_label(spark, sf_dir):
    return nodes(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@query(
    f"WITH {GRAPH}, gone AS (SELECT id FROM nodes WHERE label = 'Nation' AND CAST(substr(id, 2) AS INT) < 5) SELECT type, count(*) AS n FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) GROUP BY type"
)
def delete_nodes(spark, sf_dir):
    gone = nodes(spark, sf_dir).where("label = 'Nation' and cast(substr(id, 2) as int) < 5")
    return G.edges_by_type(G.delete_nodes(nodes(spark, sf_dir), edges(spark, sf_dir), gone)[1])


@query(f"WITH {GRAPH} SELECT src, type, dst, CASE WHEN type = 'PART_OF' THEN 0.99::DOUBLE ELSE confidence END AS confidence FROM edges UNION ALL SELECT 'n' || n_nationkey, 'NEW', 'r' || n_regionkey, 0.99::DOUBLE FROM nation")
def upsert_edges(spark, sf_dir):
    e = edges(spark, sf_dir)
    new = e.where("type = 'PART_OF'").withColumn("confidence", F.lit(0.99))
    return G.upsert_edges(e, new.unionByName(new.withColumn("type", F.lit("NEW"))))


@query(f"WITH {GRAPH} SELECT DISTINCT src AS id FROM edges WHERE src NOT IN (SELECT id FROM nodes)")
def missing_endpoints(spark, sf_dir):
    return G.missing_endpoints(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(f"WITH {GRAPH} SELECT id, CASE WHEN label = 'Region' THEN 'Area' ELSE label END AS label, title FROM nodes UNION ALL SELECT 'x1', 'Area', 'X'")
def upsert_nodes(spark, sf_dir):
    n = nodes(spark, sf_dir)
    new = n.where("label = 'Region'").withColumn("label", F.lit("Area")).unionByName(spark.createDataFrame([("x1", "Area", "X")], "id string, label string, title string"))
    return G.upsert_nodes(n, new)


@query(f"WITH {GRAPH} SELECT src, 'MENTIONED_IN' AS type, dst, max(confidence) AS confidence FROM edges WHERE type = 'LOCATED_IN' AND src IN (SELECT id FROM nodes WHERE label = 'Supplier') GROUP BY ALL")
def link_mentions(spark, sf_dir):
    n = nodes(spark, sf_dir)
    links = edges(spark, sf_dir).select(F.col("src").alias("entity_id"), F.col("dst").alias("record_id"), "confidence")
    return G.link_mentions(links, n.where("label = 'Supplier'"), n.where("label = 'Nation'")).select("src", "type", "dst", "confidence")


@query(
    f"""WITH {EXTRACTED}, kept AS (SELECT *, lower(trim(source)) || '|' || type || '|' || lower(trim(target)) AS key FROM rels)
SELECT min_by(source, ord) AS source, min_by(target, ord) AS target, min_by(type, ord) AS type, min_by(description, ord) AS description, CAST(floor(avg(strength) + 0.5) AS BIGINT) AS strength FROM kept GROUP BY key"""
)
def merge_relationships(spark, sf_dir):
    return G.merge_relationships(extracted(spark, sf_dir)[1])


@query(f"WITH {EXTRACTED} SELECT ord, source, target, type, strength FROM rels WHERE type <> 'RELATED_TO' AND (strength = 0 OR strength >= 5)")
def filter_low_value(spark, sf_dir):
    return G.filter_low_value(extracted(spark, sf_dir)[1]).select("ord", "source", "target", "type", "strength")


@query(
    f"""WITH {EXTRACTED}, kinds AS (SELECT key, type, count(*) AS n, min(ord) AS first FROM entities GROUP BY key, type),
kind AS (SELECT key, type FROM kinds QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, first) = 1),
told AS (SELECT key, description, min(ord) AS ord FROM entities WHERE description <> '' GROUP BY key, description),
texts AS (SELECT key, list(description ORDER BY ord) AS d FROM told GROUP BY key)
SELECT e.key, min_by(name, ord) AS name, any_value(k.type) AS type, coalesce(array_to_string(any_value(d)[1:6], ' ||| ') || CASE WHEN len(any_value(d)) > 6 THEN ' [...]' ELSE '' END, '') AS description
FROM entities e JOIN kind k USING (key) LEFT JOIN texts USING (key) GROUP BY e.key"""
)
def dedupe_entities(spark, sf_dir):
    return G.dedupe_entities(extracted(spark, sf_dir)[0])


_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"


@query(f"WITH {EXTRACTED}, f AS (SELECT * FROM entities QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1), x AS (SELECT name, type, sha256(type || ':' || key) AS h FROM f) SELECT name, type, {_UUID} AS id FROM x")
def first_wins_nodes(spark, sf_dir):
    return G.first_wins(extracted(spark, sf_dir)[0]).select("name", "type", "id")


@query(f"WITH {EXTRACTED}, ends AS (SELECT lower(source) AS k FROM rels WHERE strength > 8 UNION SELECT lower(target) FROM rels WHERE strength > 8) SELECT ord, name, type FROM entities WHERE type = 'Project' OR length(description) >= 50 OR key IN (SELECT k FROM ends)")
def prevent_orphans(spark, sf_dir):
    e, r = extracted(spark, sf_dir)
    return G.preserved_entities(e, r.where("strength > 8")).select("ord", "name", "type")


@query(f"WITH {EXTRACTED}, e AS (SELECT record_id, count(*) AS n, avg(length(name)) AS l FROM entities GROUP BY 1), r AS (SELECT record_id, count(*) AS r FROM rels WHERE strength > 9 GROUP BY 1) SELECT record_id FROM e LEFT JOIN r USING (record_id) WHERE n >= 3 AND coalesce(r, 0) <= 5 AND l < 20")
def toxic_docs(spark, sf_dir):
    e, r = extracted(spark, sf_dir)
    return G.toxic_documents(e, r.where("strength > 9"), least=3)


@query(f"WITH {EXTRACTED} SELECT record_id, ord FROM entities QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ord) <= least(ceil(length(name) * 10 / 40.0), 3)")
def truncate_entities(spark, sf_dir):
    e = extracted(spark, sf_dir)[0].select("record_id", "ord", F.col("ord").alias("pos"), (F.length("name") * 10).alias("content_length"))
    return G.truncate_entities(e, 40, 3).select("record_id", "ord")


@query(
    f"""WITH {EXTRACTED}, kept AS (SELECT *, lower(source) || '|' || type || '|' || lower(target) AS k FROM rels WHERE type <> 'RELATED_TO' AND (strength = 0 OR strength >= 5)),
merged AS (SELECT min_by(source, ord) AS source, min_by(target, ord) AS target, min_by(type, ord) AS type, floor(avg(strength) + 0.5) AS strength FROM kept GROUP BY k),
ends AS (SELECT lower(source) AS k FROM merged UNION SELECT lower(target) FROM merged),
good AS (SELECT * FROM entities WHERE type = 'Project' OR length(description) >= 50 OR key IN (SELECT k FROM ends)),
f AS (SELECT key, type FROM good QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1),
n AS (SELECT key, {_UUID} AS id FROM (SELECT key, sha256(type || ':' || key) AS h FROM f))
SELECT s.id AS src, d.id AS dst, m.type, m.strength / 10.0::DOUBLE AS confidence FROM merged m JOIN n s ON s.key = lower(m.source) JOIN n d ON d.key = lower(m.target)"""
)
def build_graph(spark, sf_dir):
    return G.build_graph(*extracted(spark, sf_dir))[1].select("src", "dst", "type", "confidence")


@query(f"WITH {EXTRACTED}, ends AS (SELECT ord, type, source AS name FROM rels UNION ALL SELECT ord, type, target FROM rels), lost AS (SELECT *, lower(name) AS key FROM ends WHERE lower(name) NOT IN (SELECT key FROM entities)), f AS (SELECT key, name, type FROM lost QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord, name) = 1) SELECT key, name, CASE type WHEN 'PART_OF' THEN 'Organization' WHEN 'WORKS_ON' THEN 'Project' ELSE 'Entity' END AS type FROM f")
def missing_entities(spark, sf_dir):
    e, r = extracted(spark, sf_dir)
    return G.missing_entities(r, e)


@query(f"SELECT p_partkey, {_UUID} AS id FROM (SELECT p_partkey, sha256('Part:' || lower(trim(p_name))) AS h FROM part)")
def entity_ids(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", I.entity_id(F.lit("Part"), F.col("p_name")).alias("id"))


@query(f"WITH {GRAPH}, x AS (SELECT src, type, dst, sha256(src || ':' || type || ':' || dst) AS h FROM edges WHERE type <> 'PLACED_BY') SELECT src, type, dst, {_UUID} AS id FROM x")
def relationship_ids(spark, sf_dir):
    e = edges(spark, sf_dir).where("type <> 'PLACED_BY'")
    return e.select("src", "type", "dst", I.relationship_id(F.col("src"), F.col("type"), F.col("dst")).alias("id"))


@query(
    """SELECT p_partkey, upper(CASE WHEN regexp_matches(s, '^[0-9]') THEN '_' || s ELSE s END) AS type FROM
(SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(p_size || ' ' || p_type || '?', '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM part)"""
)
def sanitize_types(spark, sf_dir):
    c = F.concat(F.col("p_size").cast("string"), F.lit(" "), F.col("p_type"), F.lit("?"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.sanitize_relationship_type(c).alias("type"))


@query(
    """WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'src/' || replace(p_brand, '#', '') || '.py' WHEN 1 THEN 'git push ' || p_name || ' --force' WHEN 2 THEN '"' || p_name || '"' ELSE '###' || p_brand || '!!!###' END AS s FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN substr(s, 5) WHEN 1 THEN array_to_string(list_filter(string_split(s, ' '), lambda w: NOT starts_with(w, '--') AND trim(w) <> '')[1:3], ' ') WHEN 2 THEN replace(s, '"', '')
ELSE CASE WHEN length(regexp_replace(s, '[a-zA-Z0-9\\s_-]', '', 'g')) > 0.3 * length(s) THEN NULL ELSE s END END AS name FROM n"""
)
def sanitize_names(spark, sf_dir):
    k = F.col("p_partkey") % 4
    s = (
        F.when(k == 0, F.concat(F.lit("src/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".py")))
        .when(k == 1, F.concat(F.lit("git push "), F.col("p_name"), F.lit(" --force")))
        .when(k == 2, F.concat(F.lit('"'), F.col("p_name"), F.lit('"')))
        .otherwise(F.concat(F.lit("###"), F.col("p_brand"), F.lit("!!!###")))
    )
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.sanitize_name(s).alias("name"))


@query(f"WITH {GRAPH} SELECT dst AS item_id, list(src ORDER BY src) AS record_ids FROM (SELECT DISTINCT src, dst FROM edges) GROUP BY dst")
def provenance(spark, sf_dir):
    return G.provenance(edges(spark, sf_dir).select(F.col("dst").alias("item_id"), F.col("src").alias("record_id")))


@query(f"WITH {GRAPH} SELECT id, list(DISTINCT src ORDER BY src) AS source_record_ids, CASE WHEN bool_or(src LIKE 's%') THEN 'new' ELSE 'old' END AS checksum FROM (SELECT dst AS id, src FROM edges WHERE type = 'LOCATED_IN') GROUP BY id")
def upsert_metadata(spark, sf_dir):
    e = edges(spark, sf_dir).where("type = 'LOCATED_IN'")
    side = lambda p, c: e.where(f"src like '{p}%'").groupBy(F.col("dst").alias("id")).agg(F.collect_set("src").alias("source_record_ids")).withColumn("checksum", F.lit(c))
    return G.upsert_metadata(side("c", "old"), side("s", "new"))


@query(f"WITH {GRAPH} SELECT src AS item_id FROM edges LEFT JOIN (SELECT 'n' || n_nationkey AS record_id, n_nationkey % 2 = 0 AS gone FROM nation) ON record_id = dst WHERE type = 'PLACED_BY' OR type = 'LOCATED_IN' GROUP BY src HAVING bool_and(coalesce(gone, true))")
def all_sources_deleted(spark, sf_dir):
    s = edges(spark, sf_dir).where("type in ('PLACED_BY', 'LOCATED_IN')").select(F.col("src").alias("item_id"), F.col("dst").alias("record_id"))
    r = nodes(spark, sf_dir).where("label = 'Nation'").select(F.col("id").alias("_id"), F.when(F.substring("id", F.lit(2), F.lit(9)).cast("int") % 2 == 0, 1).alias("deleted_at"))
    return G.all_sources_deleted(s, r)
