"""The engine's tables as views of the available data: records, vectors, metadata, nodes, edges, messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.ids import content_checksum
from kgspark.operators.search import Request, Tables
from kgspark.session import written

#: Seconds of 2024-01-01 UTC.
START = 1704067200


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as unified records with a deterministic life cycle."""
    d = F.col("doc_id")
    at = lambda s: F.timestamp_seconds(s)
    return (
        read(spark, sf_dir, "documents")
        .select(
            d,
            F.concat_ws("_", "source", "lang", d.cast("string")).alias("_id"),
            "source",
            d.cast("string").alias("source_id"),
            F.col("lang").alias("record_type"),
            F.concat(F.lit("Document "), d.cast("string")).alias("title"),
            F.col("text").alias("content"),
            at(START + d * 2220).alias("synced_at"),
            at(START + d * 53 % 1000 * 3600).alias("source_updated_at"),
            F.when(d % 17 == 0, at(F.lit(START + 5184000))).alias("deleted_at"),
            F.when(d % 3 != 0, at(F.lit(START + 1641600))).alias("last_graph_index_at"),
            F.when(d % 4 != 1, at(F.lit(START + 2073600))).alias("last_embedded_at"),
            F.lit(1).alias("version"),
        )
        .withColumn("checksum", content_checksum(F.col("title"), F.col("content")))
        .withColumn("last_graph_index_checksum", F.when(d % 5 == 0, "stale").otherwise(F.col("checksum")))
    )


RECORDS = f"""
records AS (
  SELECT doc_id, source || '_' || lang || '_' || doc_id AS _id, source, CAST(doc_id AS VARCHAR) AS source_id, lang AS record_type,
    'Document ' || doc_id AS title, text AS content, {START} + doc_id * 2220 AS synced_at, {START} + doc_id * 53 % 1000 * 3600 AS source_updated_at,
    CASE WHEN doc_id % 17 = 0 THEN {START} + 5184000 END AS deleted_at, CASE WHEN doc_id % 3 <> 0 THEN {START} + 1641600 END AS last_graph_index_at,
    CASE WHEN doc_id % 4 <> 1 THEN {START} + 2073600 END AS last_embedded_at,
    sha256(regexp_replace('Document ' || doc_id || chr(10) || text, '^\\s+|\\s+$', '', 'g')) AS checksum
  FROM documents)
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as chunk, entity and relationship vectors in turn."""
    v = F.col("vec_id")
    kind = F.element_at(F.array(F.lit("chunk"), F.lit("entity"), F.lit("relationship")), (v % 3 + 1).cast("int"))
    key = F.concat_ws("_", "source", "lang", F.col("doc_id").cast("string"))
    documents = read(spark, sf_dir, "documents")
    names = documents.select(F.col("doc_id").alias("_d"), key.alias("record_id"))
    rows = read(spark, sf_dir, "embeddings").select(
        v.alias("id"),
        kind.alias("type"),
        "embedding",
        (v * 7 % documents.count()).alias("_d"),
        F.when(v % 3 == 1, v).alias("entity_id"),
        F.when(v % 3 == 2, v - 1).alias("source_entity_id"),
        F.when(v % 3 == 2, v + 2).alias("target_entity_id"),
        F.when(v % 3 == 2, F.concat(F.lit("REL_"), (v % 5).cast("string"))).alias("rel_type"),
        F.when(v % 3 == 2, (v % 10 + 1) / 10.0).alias("confidence"),
    )
    return rows.join(names, "_d").withColumn("record_id", F.when(F.col("type") == "chunk", F.col("record_id"))).drop("_d")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and the records they come from."""
    v = F.col("vec_id")
    key = F.concat_ws("_", "source", "lang", F.col("doc_id").cast("string"))
    documents = read(spark, sf_dir, "documents")
    n = documents.count()
    names = documents.select(F.col("doc_id").alias("d"), key.alias("_id"))
    pairs = read(spark, sf_dir, "embeddings").where(v % 3 == 1).select(v.cast("string").alias("entity_id"), F.posexplode(F.array(v * 3 % n, (v * 5 + 1) % n)).alias("o", "d"))
    return pairs.join(names, "d").groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "_id"))), lambda x: x["_id"]).alias("source_record_ids"))


def record_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges between records; a fourth of them have none going out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("_", "source", "lang", F.col("doc_id").cast("string")).alias("_id"))
    d = F.col("doc_id")
    out = docs.where(d % 4 != 0).select(F.col("_id").alias("src"), ((d * 7 + 3) % docs.count()).alias("t"), F.concat(F.lit("T"), (d % 3).cast("string")).alias("type"), ((d % 10 + 1) / 10.0).alias("confidence"))
    return out.join(docs.select(F.col("doc_id").alias("t"), F.col("_id").alias("dst")), "t").select("src", "dst", "type", "confidence")


_INDEX: dict[tuple, Tables] = {}


def _files(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of each file of a table, wherever it lies."""
    java = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = java.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(java)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found))


def search_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The engine's index of a folder: its tables are derived and written on first use, then read by every search.

    An index is known by the names, sizes and times of the files it is derived from; when these change, it is made anew.
    """
    key = (spark.sparkContext.applicationId, sf_dir, *(_files(spark, f"{sf_dir}/{t}.parquet") for t in ("documents", "embeddings")))
    if key not in _INDEX:
        v = vectors(spark, sf_dir)
        v = v.select(*[F.col(c).cast("string").alias(c) if c in ("entity_id", "source_entity_id", "target_entity_id") else F.col(c) for c in v.columns])
        _INDEX[key] = Tables(*(written(t) for t in (v, metadata(spark, sf_dir), records(spark, sf_dir).select("_id", "source", "record_type", "title", "content"), record_edges(spark, sf_dir))))
    return _INDEX[key]


def request(spark: SparkSession, sf_dir: str, **options) -> Request:
    """A request whose vectors are three rows of the embeddings (chunk 0, entity 1, relationship 5)."""
    rows = {r[0]: list(r[1]) for r in read(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(0, 1, 5)).select("vec_id", "embedding").collect()}
    return Request(rows[0], rows[1], rows[5], **{"threshold": 0.1, **options})


def requests(spark: SparkSession, sf_dir: str, n: int, **options) -> list[Request]:
    """A batch of requests: the first n embeddings, each as all three vectors."""
    rows = read(spark, sf_dir, "embeddings").where(F.col("vec_id") < n).select("vec_id", "embedding").orderBy("vec_id").collect()
    return [Request(*[list(r[1])] * 3, **{"threshold": 0.1, **options}) for r in rows]


SEARCH = f"""
{RECORDS.strip()},
n AS (SELECT count(*) AS n FROM documents),
vectors AS MATERIALIZED (
  SELECT e.vec_id AS id, ['chunk', 'entity', 'relationship'][e.vec_id % 3 + 1] AS type, CAST(embedding AS DOUBLE[]) AS e, r._id AS record_id
  FROM embeddings e, n, records r WHERE r.doc_id = e.vec_id * 7 % n),
metadata AS MATERIALIZED (
  SELECT e.vec_id AS entity_id, o, r._id FROM embeddings e, n, (VALUES (0), (1)) AS t(o), records r
  WHERE e.vec_id % 3 = 1 AND r.doc_id = CASE o WHEN 0 THEN e.vec_id * 3 % n ELSE (e.vec_id * 5 + 1) % n END),
edges AS (
  SELECT a._id AS src, b._id AS dst, 'T' || (a.doc_id % 3) AS type, (a.doc_id % 10 + 1) / 10.0::DOUBLE AS confidence
  FROM records a, n, records b WHERE b.doc_id = (a.doc_id * 7 + 3) % n AND a.doc_id % 4 <> 0),
q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id IN (0, 1, 5)),
hits AS MATERIALIZED (SELECT v.*, q.vec_id AS query, list_cosine_similarity(e, q) AS score FROM vectors v, q),
named AS MATERIALIZED (
  SELECT query, h.id, coalesce(s._id, CAST(h.id - 1 AS VARCHAR)) AS src, coalesce(d._id, CAST(h.id + 2 AS VARCHAR)) AS dst, (h.id % 10 + 1) / 10.0::DOUBLE AS confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS n FROM hits WHERE type = 'relationship' AND score >= 0.1) h
  LEFT JOIN metadata s ON s.entity_id = h.id - 1 AND s.o = 0 LEFT JOIN metadata d ON d.entity_id = h.id + 2 AND d.o = 0
  WHERE n <= CASE query WHEN 1 THEN 30 ELSE 60 END),
found AS (
  SELECT m._id AS id, max(score) AS score FROM (SELECT * FROM hits WHERE query = 1 AND type = 'entity' AND score >= 0.1 ORDER BY score DESC, id LIMIT 60) h
  JOIN metadata m ON m.entity_id = h.id GROUP BY 1),
around AS (SELECT * FROM edges WHERE src IN (SELECT id FROM found) OR dst IN (SELECT id FROM found)),
local_scores AS (
  SELECT id, max(score) AS score FROM (
    SELECT id, score FROM found UNION ALL SELECT src, confidence FROM around UNION ALL SELECT dst, confidence FROM around
    UNION ALL SELECT src, confidence FROM named WHERE query = 1 UNION ALL SELECT dst, confidence FROM named WHERE query = 1) GROUP BY id),
local_rows AS (
  SELECT _id, coalesce(s.score, 0.0) AS score FROM records LEFT JOIN local_scores s ON s.id = _id
  WHERE _id IN (SELECT src FROM around UNION SELECT dst FROM around) ORDER BY score DESC, _id LIMIT 20),
global_scores AS (SELECT id, max(confidence) AS score FROM (SELECT src AS id, confidence FROM named WHERE query = 5 UNION ALL SELECT dst, confidence FROM named WHERE query = 5) GROUP BY id),
global_rows AS (SELECT _id, s.score FROM records JOIN global_scores s ON s.id = _id ORDER BY score DESC, _id LIMIT 20),
ordered AS (
  SELECT 0 AS m, row_number() OVER (ORDER BY score DESC, _id) AS p, * FROM local_rows UNION ALL
  SELECT 1, row_number() OVER (ORDER BY score DESC, _id), * FROM global_rows),
hybrid_rows AS (
  SELECT _id, score FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY m, p) AS n FROM ordered) WHERE n = 1 ORDER BY m, p LIMIT 20)
"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, suppliers, nations and regions as nodes."""
    parts = [
        read(spark, sf_dir, t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.lit(label).alias("label"), F.col(n).alias("title"))
        for t, p, k, label, n in (("customer", "c", "c_custkey", "Customer", "c_name"), ("supplier", "s", "s_suppkey", "Supplier", "s_name"), ("nation", "n", "n_nationkey", "Nation", "n_name"), ("region", "r", "r_regionkey", "Region", "r_name"))
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where customers and suppliers are, what nations belong to, who placed orders."""
    link = lambda t, a, ka, b, kb, kind, w: read(spark, sf_dir, t).select(
        F.concat(F.lit(a), F.col(ka).cast("string")).alias("src"), F.lit(kind).alias("type"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("dst"), ((F.col(w) % 10 + 1) / 10.0).alias("confidence")
    )
    return (
        link("customer", "c", "c_custkey", "n", "c_nationkey", "LOCATED_IN", "c_custkey")
        .unionByName(link("supplier", "s", "s_suppkey", "n", "s_nationkey", "LOCATED_IN", "s_suppkey"))
        .unionByName(link("nation", "n", "n_nationkey", "r", "n_regionkey", "PART_OF", "n_nationkey"))
        .unionByName(link("orders", "o", "o_orderkey", "c", "o_custkey", "PLACED_BY", "o_orderkey"))
    )


GRAPH = """
nodes AS (
  SELECT 'c' || c_custkey AS id, 'Customer' AS label, c_name AS title FROM customer UNION ALL SELECT 's' || s_suppkey, 'Supplier', s_name FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'Nation', n_name FROM nation UNION ALL SELECT 'r' || r_regionkey, 'Region', r_name FROM region),
edges AS (
  SELECT 'c' || c_custkey AS src, 'LOCATED_IN' AS type, 'n' || c_nationkey AS dst, (c_custkey % 10 + 1) / 10.0::DOUBLE AS confidence FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'LOCATED_IN', 'n' || s_nationkey, (s_suppkey % 10 + 1) / 10.0::DOUBLE FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'PART_OF', 'r' || n_regionkey, (n_nationkey % 10 + 1) / 10.0::DOUBLE FROM nation
  UNION ALL SELECT 'o' || o_orderkey, 'PLACED_BY', 'c' || o_custkey, (o_orderkey % 10 + 1) / 10.0::DOUBLE FROM orders)
"""


def extracted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relationships as an extractor would give them, from parts and lines."""
    part = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    entities = part.select(
        k.alias("ord"),
        (k % 50).alias("record_id"),
        k.alias("doc_ord"),
        F.lit(0).alias("pos"),
        F.when(k % 3 == 0, F.upper("p_brand")).when(k % 3 == 1, F.concat(F.lit(" "), F.col("p_brand"))).otherwise(F.col("p_brand")).alias("name"),
        F.when(k % 4 == 0, "Project").when(k % 4 == 1, "Task").otherwise("Topic").alias("type"),
        F.when(k % 5 != 0, F.concat(F.lit("size "), F.col("p_size").cast("string"))).otherwise("").alias("description"),
    )
    rels = part.select(
        k.alias("ord"),
        (k % 50).alias("record_id"),
        F.col("p_brand").alias("source"),
        F.concat(F.lit("Brand#"), (k % 60).cast("string")).alias("target"),
        F.element_at(F.array(*map(F.lit, ["USES", "RELATED_TO", "PART_OF", "WORKS_ON"])), (k % 4 + 1).cast("int")).alias("type"),
        F.concat(F.lit("of "), k.cast("string")).alias("description"),
        (k % 11).alias("strength"),
    )
    return entities, rels


EXTRACTED = """
entities AS (
  SELECT p_partkey AS ord, p_partkey % 50 AS record_id, CASE p_partkey % 3 WHEN 0 THEN upper(p_brand) WHEN 1 THEN ' ' || p_brand ELSE p_brand END AS name,
    CASE p_partkey % 4 WHEN 0 THEN 'Project' WHEN 1 THEN 'Task' ELSE 'Topic' END AS type, CASE WHEN p_partkey % 5 <> 0 THEN 'size ' || p_size ELSE '' END AS description,
    lower(trim(p_brand)) AS key FROM part),
rels AS (
  SELECT p_partkey AS ord, p_partkey % 50 AS record_id, p_brand AS source, 'Brand#' || (p_partkey % 60) AS target, ['USES', 'RELATED_TO', 'PART_OF', 'WORKS_ON'][p_partkey % 4 + 1] AS type,
    'of ' || p_partkey AS description, p_partkey % 11 AS strength FROM part)
"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as messages of threads."""
    return read(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.col("conv_id").alias("thread"), "turn", "role", "text", F.concat_ws("-", "conv_id", "turn").alias("source_id")
    )
