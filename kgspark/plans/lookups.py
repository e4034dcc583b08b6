"""Queries over single operators: reads by key, registry and metadata states, pages, runs, and the vector index."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions import dates
from kgspark.operators import chunks as C
from kgspark.operators import extraction as E
from kgspark.operators import graph as G
from kgspark.operators import metrics as M
from kgspark.operators import records as R
from kgspark.operators import registry
from kgspark.operators import workflows as W
from kgspark.plans.quality import _JUDGED, _judged
from kgspark.plans.registry import query
from kgspark.plans.tables import GRAPH, RECORDS, START, edges, nodes, read, records


@query(f"WITH {GRAPH}, asked AS (SELECT 'n' || c_custkey AS id FROM customer) SELECT id FROM asked WHERE id IN (SELECT id FROM nodes)")
def point_reads(spark, sf_dir):
    """Which of some ids are nodes."""
    return G.existing_ids(read(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("id")), nodes(spark, sf_dir))


@query(f"WITH {GRAPH}, keys AS (SELECT 'n' || n_nationkey AS src, 'PART_OF' AS type, 'r' || (n_nationkey % 5) AS dst FROM nation) SELECT src, type, dst FROM keys WHERE (src, type, dst) IN (SELECT (src, type, dst) FROM edges)")
def edge_keys_found(spark, sf_dir):
    k = F.col("n_nationkey")
    keys = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), k.cast("string")).alias("src"), F.lit("PART_OF").alias("type"), F.concat(F.lit("r"), (k % 5).cast("string")).alias("dst"))
    return G.existing_edges(keys, edges(spark, sf_dir)).select("src", "type", "dst")


@query(f"WITH {GRAPH} SELECT DISTINCT type AS name FROM edges JOIN nodes s ON s.id = src JOIN nodes d ON d.id = dst WHERE s.label = 'Customer' AND d.label = 'Nation'")
def valid_relationship_types(spark, sf_dir):
    types = registry.discovered(nodes(spark, sf_dir), edges(spark, sf_dir))[1]
    return registry.valid_relationships(types, "Customer", "Nation").select("name")


@query(f"WITH {GRAPH} SELECT DISTINCT type FROM edges WHERE type <> 'PART_OF'")
def new_types(spark, sf_dir):
    known = spark.createDataFrame([("PART_OF",), ("OTHER",)], "type string")
    return G.discover_types(edges(spark, sf_dir), known)


@query("SELECT label AS name, min(title) AS description FROM (SELECT p_type AS label, p_name AS title FROM part WHERE p_size > 10) WHERE label NOT IN (SELECT p_type FROM part WHERE p_size <= 10) GROUP BY 1 UNION ALL SELECT p_type, min(p_name) FROM part WHERE p_size <= 10 GROUP BY 1")
def registry_additions(spark, sf_dir):
    """New types by name; of equal names the least row."""
    rows = read(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.col("p_name").alias("description"), "p_size")
    old = rows.where("p_size <= 10").groupBy("name").agg(F.min("description").alias("description"))
    return registry.add(old, rows.where("p_size > 10").select("name", "description"))


def _metadata(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rows = p.select(k.cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.lit("").alias("description"))
    state = C.embedding_state(rows)
    return state.withColumn("embedded_checksum", F.when(F.col("id").cast("long") % 3 == 0, F.col("content_checksum")).when(F.col("id").cast("long") % 3 == 1, F.lit("old")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_partkey % 3 <> 0")
def needs_reembedding(spark, sf_dir):
    return R.needs_reembedding(_metadata(spark, sf_dir)).select("id")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, sha256('{"text":"' || lower(trim(p_name)) || '","entityType":"' || lower(trim(p_type)) || '"}') AS embedded_checksum, CAST(64 AS INT) AS dimension FROM part WHERE p_partkey % 3 <> 0""")
def refreshed_embeddings(spark, sf_dir):
    """Metadata embedded anew."""
    return C.refresh_embeddings(_metadata(spark, sf_dir)).select("id", "embedded_checksum", F.size("embedding").alias("dimension"))


@query(f"WITH {RECORDS} SELECT _id, checksum FROM records WHERE doc_id % 2 = 0 UNION ALL SELECT _id, 'kept' FROM records WHERE doc_id % 2 = 1")
def vector_upsert(spark, sf_dir):
    """The chunk index after half of the records changed: their old points go and new ones come."""
    r = records(spark, sf_dir)
    old = r.select(F.concat_ws("#", "_id", F.lit(0)).alias("id"), F.lit("chunk").alias("type"), F.col("_id").alias("record_id"), F.lit("kept").alias("checksum"), F.lit(0).alias("chunk_index"), F.array(F.lit(0.0).cast("float")).alias("embedding"))
    return C.index_vectors(old, r.where("doc_id % 2 = 0")).groupBy(F.col("record_id").alias("_id")).agg(F.min("checksum").alias("checksum"))


@query(f"WITH {RECORDS} SELECT _id FROM records WHERE doc_id % 5 = 0")
def outdated_vectors(spark, sf_dir):
    """Chunk vectors whose record changed."""
    r = records(spark, sf_dir)
    old = r.select(F.lit("chunk").alias("type"), F.col("_id").alias("record_id"), F.col("last_graph_index_checksum").alias("checksum"))
    return C.outdated(old, r).select(F.col("record_id").alias("_id"))


@query(f"WITH {GRAPH} SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM edges WHERE type = 'PLACED_BY' UNION SELECT dst FROM edges WHERE type = 'PLACED_BY')")
def metadata_without_mentions(spark, sf_dir):
    e = edges(spark, sf_dir).where("type = 'PLACED_BY'")
    mentions = e.select(F.col("src").alias("rel_id")).union(e.select("dst"))
    return G.without_mentions(nodes(spark, sf_dir), mentions).select("id")


@query("SELECT 'p' || p_partkey AS id FROM part WHERE p_partkey % 2 = 1")
def metadata_not_in_graph(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), "p_partkey")
    return G.not_in_graph(p.select("id"), p.where("p_partkey % 2 = 0"))


@query("SELECT o_custkey AS rel_id, max(o_orderkey) AS extracted_at FROM orders GROUP BY 1")
def latest_mentions(spark, sf_dir):
    """Mentions by key, the latest extraction of each."""
    m = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rel_id"), F.lit("r").alias("record_id"), F.col("o_orderkey").alias("extracted_at"))
    return G.add_mentions(m.where("extracted_at % 2 = 0"), m.where("extracted_at % 2 = 1")).select("rel_id", "extracted_at")


@query(f"WITH {GRAPH} SELECT src, type, dst, confidence FROM edges WHERE src LIKE 'c1%' ORDER BY src, type, dst LIMIT 50 OFFSET 10")
def edges_page(spark, sf_dir):
    """A page of the edges whose source starts with a text."""
    return G.edges_from(edges(spark, sf_dir), "c1", 10, 50).select("src", "type", "dst", "confidence")


@query(f"WITH {GRAPH} SELECT src AS id FROM edges WHERE type = 'LOCATED_IN' AND dst = 'n3' UNION SELECT dst FROM edges WHERE type = 'LOCATED_IN' AND src = 'n3'")
def document_neighbours(spark, sf_dir):
    """Ends of one document's edges of a type (I16)."""
    return G.neighbours_of_document(edges(spark, sf_dir), "n3", "LOCATED_IN")


@query(f"WITH {GRAPH}, m AS (SELECT dst AS id, list(src ORDER BY src) AS s FROM (SELECT DISTINCT src, dst FROM edges) GROUP BY 1) SELECT id, list_filter(s, lambda x: x <> 'n1') AS source_record_ids FROM m WHERE len(list_filter(s, lambda x: x <> 'n1')) > 0")
def provenance_removed(spark, sf_dir):
    """Metadata without one record."""
    m = edges(spark, sf_dir).groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("source_record_ids"))
    return G.remove_provenance(m, "n1")


@query(f"WITH {GRAPH} SELECT label, count(*) AS n FROM (SELECT id, label FROM nodes WHERE id NOT IN (SELECT 'n' || n_nationkey FROM nation) UNION ALL SELECT 'n' || n_nationkey, 'Place' FROM nation) GROUP BY 1")
def config_entities_indexed(spark, sf_dir):
    """Nodes after a configuration's entities came, repeated ones once."""
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("Place").alias("type"), F.col("n_name").alias("title"))
    e = edges(spark, sf_dir)
    return G.index_config_entities(nodes(spark, sf_dir), e, n.union(n.withColumn("title", F.lit("~"))), e.limit(0))[0].groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {GRAPH} SELECT src, type, dst, coalesce(s.title, src) || ' -[' || type || ']-> ' || coalesce(d.title, dst) AS text FROM edges LEFT JOIN nodes s ON s.id = src LEFT JOIN nodes d ON d.id = dst")
def relationship_texts(spark, sf_dir):
    """What is embedded for each edge, by its ends' titles."""
    e = edges(spark, sf_dir).withColumn("description", F.lit(""))
    return G.relationship_texts(e, nodes(spark, sf_dir)).select("src", "type", "dst", "text")


@query("SELECT p_partkey AS recording_id, lower(p_name) AS title, count(l_orderkey) AS details FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE regexp_matches(lower(p_name), 'a|1') GROUP BY 1, 2 HAVING count(l_orderkey) > 0")
def work_context(spark, sf_dir):
    """Chosen meetings and the details recorded of them."""
    meetings = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("recording_id"), F.lower("p_name").alias("title"))
    chosen, details = W.work_context(meetings, read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("recording_id")), ["a", "1"])
    return chosen.join(details, "recording_id").groupBy("recording_id", "title").agg(F.count("*").alias("details"))


@query("SELECT stage, count(*) AS n, count(a) AS with_a FROM (SELECT 'nation' AS stage, n_nationkey AS a FROM nation UNION ALL SELECT 'region', NULL FROM region) GROUP BY 1")
def context_union(spark, sf_dir):
    """Stages' rows together, missing columns null."""
    parts = [read(spark, sf_dir, "nation").select(F.lit("nation").alias("stage"), F.col("n_nationkey").alias("a")), read(spark, sf_dir, "region").select(F.lit("region").alias("stage"))]
    return W.combine(parts).groupBy("stage").agg(F.count("*").alias("n"), F.count("a").alias("with_a"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderdate AS at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def last_sync_states(spark, sf_dir):
    """The last runs of a log."""
    return R.newest(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at")), "at", "id", 10)


@query(f"WITH {RECORDS} SELECT _id, synced_at AS synced_s FROM records ORDER BY synced_at DESC, _id LIMIT 1")
def newest_record(spark, sf_dir):
    return R.newest(records(spark, sf_dir), "synced_at", "_id").select("_id", F.unix_seconds("synced_at").alias("synced_s"))


@query("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS runs, sum(o_custkey) AS day_n FROM orders GROUP BY 1")
def run_log(spark, sf_dir):
    """A log with a further run and the totals of each day."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("start"), F.col("o_custkey").alias("n"), "o_orderkey")
    rows = M.run_log(o.where("o_orderkey % 2 = 0").drop("o_orderkey"), o.where("o_orderkey % 2 = 1").drop("o_orderkey"))
    return rows.groupBy(F.to_date("start").alias("day")).agg(F.count("*").alias("runs"), F.max("day_n").alias("day_n"))


@query("SELECT CAST(min(o_orderdate) AS DATE) - 7 AS start, CAST(min(o_orderdate) AS DATE) AS \"end\" FROM orders")
def next_range(spark, sf_dir):
    """The range to make next."""
    return M.next_range(read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("start")), 7)


@query(f"""WITH {_JUDGED}, x AS (SELECT query, sum(rel) / count(*)::DOUBLE AS p, sum(rel) / any_value(m)::DOUBLE AS r, 1.0 / min(CASE WHEN rel = 1 THEN pos END) AS mrr FROM j JOIN m USING (query) GROUP BY 1)
SELECT query, printf('precision: %.3f, recall: %.3f, mrr: %.3f', p, r, mrr) AS line FROM x""")
def accuracy_bundle(spark, sf_dir):
    """All measures of each query, and a line of text."""
    return M.formatted(M.evaluate(*_judged(spark, sf_dir)), ["precision", "recall", "mrr"])


@query(f"WITH {RECORDS}, s AS (SELECT CASE WHEN contains(content, 'thtion') THEN 'success' ELSE 'empty' END AS status FROM records WHERE coalesce(trim(content), '') <> '') SELECT status, count(*) AS n FROM s GROUP BY 1")
def indexing_by_status(spark, sf_dir):
    """Records by what came of their extraction."""
    results = E.classify(E.extract(records(spark, sf_dir), E.dictionary_extractor({"thtion": "Person"})))
    return results.groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || CASE WHEN m = 1 THEN ' minute ago' ELSE ' minutes ago' END WHEN m < 1440 THEN m // 60 || CASE WHEN m // 60 = 1 THEN ' hour ago' ELSE ' hours ago' END ELSE m // 1440 || CASE WHEN m // 1440 = 1 THEN ' day ago' ELSE ' days ago' END END AS said FROM (SELECT doc_id, doc_id * 29 // 60 AS m FROM documents)")
def relative_times(spark, sf_dir):
    """How long ago, in words."""
    now = F.timestamp_seconds(F.lit(START))
    return read(spark, sf_dir, "documents").select("doc_id", dates.relative_time(F.timestamp_seconds(F.lit(START) - F.col("doc_id") * 29), now).alias("said"))

