"""Vector search and the query modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.vector import cosine, literal
from kgspark.operators import search as S
from kgspark.operators.graph import one_hop
from kgspark.operators.graph import score_map as scores_of
from kgspark.plans.registry import query
from kgspark.plans.tables import SEARCH, request, requests, search_tables, vectors

_OUT = "SELECT r.source, r.record_type, r._id, round(x.score, 6) AS score FROM {} x JOIN records r USING (_id)"


def _run(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    rows = S.retrieve(search_tables(spark, sf_dir), request(spark, sf_dir, mode=mode))
    return rows.select("source", "record_type", "_id", F.round("score", 6).alias("score"))


@query(f"WITH {SEARCH} SELECT id, round(score, 6) AS score FROM hits WHERE query = 0 AND type = 'chunk' AND hits.score >= 0.1 ORDER BY hits.score DESC, id LIMIT 20")
def vec_topk(spark, sf_dir):
    r = request(spark, sf_dir)
    return S.top_k(search_tables(spark, sf_dir).vectors, r.vector, 20, r.threshold, "chunk").select("id", F.round("score", 6).alias("score"))


@query(f"WITH {SEARCH}, best AS (SELECT record_id AS _id, max(score) AS score FROM (SELECT * FROM hits WHERE query = 0 AND type = 'chunk' AND score >= 0.1 ORDER BY score DESC, id LIMIT 20) GROUP BY 1) " + _OUT.format("best"))
def retrieve_naive(spark, sf_dir):
    return _run(spark, sf_dir, "naive")


@query(f"WITH {SEARCH} " + _OUT.format("local_rows"))
def retrieve_local(spark, sf_dir):
    return _run(spark, sf_dir, "local")


@query(f"WITH {SEARCH} " + _OUT.format("global_rows"))
def retrieve_global(spark, sf_dir):
    return _run(spark, sf_dir, "global")


@query(f"WITH {SEARCH} " + _OUT.format("hybrid_rows"))
def retrieve_hybrid(spark, sf_dir):
    return _run(spark, sf_dir, "hybrid")


_MIXED = """, mixed AS (
  SELECT h._id, len(list_intersect(['of', 'the', 'with'], string_split_regex(lower(r.title || chr(10) || substr(r.content, 1, 500)), '\\s+'))) / 3.0::DOUBLE AS score
  FROM hybrid_rows h JOIN records r USING (_id)),
best AS (SELECT * FROM mixed WHERE score >= 0.3 ORDER BY score DESC, _id LIMIT 20) """


@query(f"WITH {SEARCH}{_MIXED}" + _OUT.format("best"))
def retrieve_mix_threshold(spark, sf_dir):
    t, r = search_tables(spark, sf_dir), request(spark, sf_dir, text="the with of")
    return S.retrieve(t, r, S.overlap_scorer(r.text), 0.3).select("source", "record_type", "_id", F.round("score", 6).alias("score"))


@query(f"WITH {SEARCH} " + _OUT.format("hybrid_rows"))
def retrieve_mix_without_reranker(spark, sf_dir):
    return _run(spark, sf_dir, "mix")


@query(
    f"""WITH {SEARCH}, asked AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id < 40),
near AS MATERIALIZED (SELECT a.query, v.record_id, list_cosine_similarity(e, q) AS score, v.id FROM vectors v, asked a WHERE type = 'chunk'),
best AS (SELECT query, record_id AS _id, max(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS n FROM near WHERE score >= 0.1) WHERE n <= 20 GROUP BY 1, 2)
SELECT CAST(query AS INT) AS query, _id, round(score, 6) AS score FROM best JOIN records USING (_id)"""
)
def retrieve_batch(spark, sf_dir):
    return S.answer(search_tables(spark, sf_dir), requests(spark, sf_dir, 40, mode="naive")).select("query", "_id", F.round("score", 6).alias("score"))


@query(f"WITH {SEARCH} SELECT id, round(max(score), 6) AS score FROM found GROUP BY id")
def entity_records(spark, sf_dir):
    r = request(spark, sf_dir)
    return S.records_of_entities(search_tables(spark, sf_dir), r.low, r.top_k, r.threshold).withColumn("score", F.round("score", 6))


@query(f"WITH {SEARCH} SELECT src, dst, confidence, CAST(floor(confidence * 10 + 0.5) AS BIGINT) AS weight FROM named WHERE query = 5")
def keyword_relationships(spark, sf_dir):
    r = request(spark, sf_dir)
    rows = S.relationships_of_query(search_tables(spark, sf_dir), r.high, r.top_k, r.threshold)
    return rows.select("src", "dst", "confidence", S.edge_weight(F.col("confidence")).alias("weight"))


@query(f"WITH {SEARCH} SELECT id, round(score, 6) AS score FROM local_scores")
def score_map(spark, sf_dir):
    t, r = search_tables(spark, sf_dir), request(spark, sf_dir)
    found = S.records_of_entities(t, r.low, r.top_k, r.threshold)
    named = S.relationships_of_query(t, r.low, r.top_k // 2, r.threshold)
    around = one_hop(t.edges, found).select("src", "dst", "type", "confidence")
    return scores_of(around.unionByName(named), found).withColumn("score", F.round("score", 6))


@query(
    """SELECT label, vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score
FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1"""
)
def first_wins_dedup(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = request(spark, sf_dir).vector
    rows = rows.select("label", F.col("vec_id").alias("id"), F.round(cosine(F.col("embedding"), literal(q)), 6).alias("score"))
    return S.first_wins(rows, "label", [F.desc("score"), F.col("id")])


@query(f"WITH {SEARCH} SELECT type, count(*) AS points, CAST(max(len(e)) AS INT) AS dimension FROM vectors GROUP BY type")
def vector_stats(spark, sf_dir):
    return vectors(spark, sf_dir).groupBy("type").agg(F.count("*").alias("points"), F.max(F.size("embedding")).alias("dimension"))
