"""Queries over the record table."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from kgspark.functions import dates as D
from kgspark.functions import ids as I
from kgspark.functions import text as T
from kgspark.operators import chunks as C
from kgspark.operators import records as R
from kgspark.plans.registry import query
from kgspark.plans.tables import RECORDS, START, read, records

_W = f"WITH {RECORDS} "


@query(_W + "SELECT _id, checksum FROM records")
def content_checksum(spark, sf_dir):
    return records(spark, sf_dir).select("_id", "checksum")


@query(_W + "SELECT _id FROM records WHERE deleted_at IS NULL AND (last_graph_index_at IS NULL OR doc_id % 5 = 0)")
def needs_graph_index(spark, sf_dir):
    return R.needs_graph_index(records(spark, sf_dir)).select("_id")


@query(_W + "SELECT _id FROM records WHERE deleted_at IS NULL AND (last_embedded_at IS NULL OR source_updated_at > last_embedded_at)")
def needs_embedding(spark, sf_dir):
    return R.needs_embedding(records(spark, sf_dir)).select("_id")


@query(_W + "SELECT record_type, count(*) AS n FROM records WHERE deleted_at IS NULL GROUP BY 1")
def records_by_type(spark, sf_dir):
    return R.records_by_type(records(spark, sf_dir))


@query(_W + "SELECT source, count(*) AS total, count(last_embedded_at) AS embedded, count(last_graph_index_at) AS graph_indexed, max(synced_at) AS last_sync FROM records GROUP BY 1")
def records_by_source(spark, sf_dir):
    return R.records_by_source(records(spark, sf_dir)).withColumn("last_sync", F.unix_seconds("last_sync"))


_NOW = datetime.datetime(2024, 2, 1)


@query(
    _W
    + f"SELECT count(*) AS total, count(*) FILTER (deleted_at IS NULL) AS live, count(deleted_at) AS deleted, count(last_embedded_at) AS embedded, count(*) FILTER (source_updated_at >= {START + 31 * 86400 - 86400}) AS updated_last_day, count(DISTINCT source) AS sources FROM records"
)
def overview(spark, sf_dir):
    return R.overview(records(spark, sf_dir), _NOW)


@query(_W + "SELECT _id, CASE WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM records WHERE doc_id % 11 <> 0 UNION ALL SELECT _id, 'deleted' FROM records WHERE doc_id % 11 = 0 AND doc_id % 7 <> 0")
def change_detect(spark, sf_dir):
    r = records(spark, sf_dir)
    old = r.where("doc_id % 7 <> 0").withColumn("checksum", F.when(F.col("doc_id") % 3 == 0, F.lit("old")).otherwise(F.col("checksum")))
    return R.changes(r.where("doc_id % 11 <> 0"), old, with_deleted=True)


@query(
    _W
    + """, new AS (SELECT _id, doc_id, CASE WHEN doc_id % 6 = 0 THEN 'Newest' WHEN doc_id % 6 = 2 THEN 'New' ELSE 'Tied ' || doc_id END AS t FROM records WHERE doc_id % 2 = 0
UNION ALL SELECT 'x' || _id, doc_id, 'Unseen' FROM records WHERE doc_id % 10 = 1)
SELECT coalesce(r._id, n._id) AS _id, coalesce(t, title) AS title, CASE WHEN r._id IS NULL THEN 1 WHEN t IS NOT NULL THEN 2 ELSE 1 END AS version, CASE WHEN t IS NOT NULL THEN sha256(t || chr(10) || 'x') ELSE checksum END AS checksum
FROM records r FULL JOIN new n ON n._id = r._id"""
)
def record_upsert(spark, sf_dir):
    """New rows with later, equal and null times, and records that were not there before."""
    all_rows = records(spark, sf_dir)
    r, d = all_rows.drop("doc_id"), F.col("doc_id")
    even = all_rows.where(d % 2 == 0).withColumn("content", F.lit("x"))
    later = F.timestamp_seconds(F.unix_seconds("synced_at") + 5)
    none = F.lit(None).cast("timestamp")
    # d % 6 is 0: a later row beside a null time; 2: null times only; 4: equal times, of which the larger title wins.
    new = even.withColumns({"title": F.when(d % 6 == 0, "Old").when(d % 6 == 2, "New").otherwise("A tie"), "synced_at": F.when(d % 6 != 4, none).otherwise(F.col("synced_at"))})
    more = even.withColumns({"title": F.when(d % 6 == 0, "Newest").when(d % 6 == 2, "Lost").otherwise(F.concat(F.lit("Tied "), d.cast("string"))), "synced_at": F.when(d % 6 == 0, later).when(d % 6 == 4, F.col("synced_at")).otherwise(none)})
    unseen = all_rows.where(d % 10 == 1).withColumns({"_id": F.concat(F.lit("x"), F.col("_id")), "title": F.lit("Unseen"), "content": F.lit("x"), "synced_at": none})
    out = R.upsert(r, new.unionByName(more).unionByName(unseen).drop("doc_id"), ["last_graph_index_at", "last_graph_index_checksum", "last_embedded_at"])
    return out.select("_id", "title", "version", "checksum")


@query(_W + "SELECT _id, title FROM records WHERE deleted_at IS NULL AND source = 'src3' AND record_type = 'en' ORDER BY _id LIMIT 10 OFFSET 5")
def records_page(spark, sf_dir):
    return R.by_source(records(spark, sf_dir), "src3", "en", 5, 10).select("_id", "title")


@query(_W + f"SELECT _id FROM records WHERE CASE WHEN doc_id % 6 <> 0 THEN source_updated_at END >= {START + 864000} OR doc_id % 6 = 0")
def cutoff_filter(spark, sf_dir):
    date = F.when(F.col("doc_id") % 6 != 0, F.col("source_updated_at"))
    return R.cutoff(records(spark, sf_dir), date, datetime.datetime(2024, 1, 11)).select("_id")


@query("SELECT count(*) AS total, count(*) FILTER (n > 0) AS with_mentions, count(*) FILTER (n = 0) AS orphans, avg(n) AS mean_mentions FROM (SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1)")
def mention_stats(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.collect_list("s_suppkey").alias("mentions"))
    return R.mention_statistics(read(spark, sf_dir, "nation").join(s, "n_nationkey", "left"))


@query(_W + ", s AS (SELECT source, max(synced_at) AS t FROM records GROUP BY 1 ORDER BY t DESC, source LIMIT 10) SELECT s.source, s.t AS synced_s, count(r._id) AS n FROM s LEFT JOIN records r ON r.source = s.source AND abs(r.synced_at - s.t) <= 45000 GROUP BY ALL")
def activity_window(spark, sf_dir):
    r = records(spark, sf_dir)
    states = r.groupBy("source").agg(F.max("synced_at").alias("synced_at"))
    return R.activity(states, r, minutes=750).select("source", F.unix_seconds("synced_at").alias("synced_s"), "n")


@query(_W + "SELECT _id, 'ID: ' || _id || chr(10) || '# ' || title || chr(10) || chr(10) || content AS text, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens, substr(content, 1, 500) AS snippet FROM records")
def content_texts(spark, sf_dir):
    return records(spark, sf_dir).select("_id", T.content_text(F.col("_id"), F.col("title"), F.col("content")).alias("text"), T.estimate_tokens(F.col("content")).alias("tokens"), T.snippet(F.col("content")).alias("snippet"))


_CHUNKS = r"""
WITH RECURSIVE t AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents),
s AS (SELECT doc_id, text, string_split_regex(text, '\n\n+') AS seg FROM t),
fold AS (
  SELECT doc_id, seg, 0 AS i, '' AS cur, CAST(0 AS BIGINT) AS st, CAST([] AS STRUCT(text VARCHAR, st BIGINT)[]) AS done FROM s WHERE length(text) > 2000
  UNION ALL
  SELECT doc_id, seg, i + 1,
    CASE WHEN length(cur) + length(seg[i + 1]) + 1 > 2000 THEN CASE WHEN length(cur) > 0 THEN right(cur, 200) || ' ' || seg[i + 1] ELSE seg[i + 1] END ELSE cur || CASE WHEN length(cur) > 0 THEN ' ' ELSE '' END || seg[i + 1] END,
    CASE WHEN length(cur) + length(seg[i + 1]) + 1 > 2000 AND length(cur) > 0 THEN st + length(cur) - length(right(cur, 200)) ELSE st END,
    CASE WHEN length(cur) + length(seg[i + 1]) + 1 > 2000 AND length(cur) > 0 THEN list_append(done, {'text': cur, 'st': st}) ELSE done END
  FROM fold WHERE i < len(seg)),
last AS (SELECT doc_id, CASE WHEN length(cur) > 0 THEN list_append(done, {'text': cur, 'st': st}) ELSE done END AS c FROM fold WHERE i = len(seg)),
many AS (SELECT doc_id, unnest(range(0, len(c))) AS i, c FROM last)
SELECT doc_id, CAST(i AS INT) AS index, sha256(regexp_replace(c[i + 1].text, '^\s+|\s+$', '', 'g')) AS text_sha, CAST(c[i + 1].st AS INT) AS start, CAST(c[i + 1].st + length(c[i + 1].text) AS INT) AS "end" FROM many
UNION ALL SELECT doc_id, 0, sha256(text), 0, CAST(length(text) AS INT) FROM t WHERE length(text) <= 2000
"""


@query(_CHUNKS)
def chunk_text(spark, sf_dir):
    text = F.regexp_replace("text", "\n", "\n\n")
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(C.chunk(text)).alias("c"))
    return rows.select("doc_id", "c.index", F.sha2("c.text", 256).alias("text_sha"), "c.start", "c.end")


@query()
def vector_index(spark, sf_dir):
    """Chunk vectors of all live records that need them, by the stand-in embedder."""
    fresh = C.embed(C.chunk_records(R.needs_embedding(records(spark, sf_dir))), "text")
    return fresh.select("record_id", "index", "start", "end", F.size("embedding").alias("dimension"))


@query("SELECT p_partkey, sha256('{\"text\":\"' || lower(p_name) || '\",\"entityType\":\"' || lower(p_type) || '\"}') AS checksum FROM part")
def embedding_checksum(spark, sf_dir):
    c = I.embedding_checksum(text=F.col("p_name"), entityType=F.col("p_type"), description=F.lit(""))
    return read(spark, sf_dir, "part").select("p_partkey", c.alias("checksum"))


@query(
    f"SELECT event_id, {START} + event_id * 1000 AS from_seconds, {START} + event_id * 1000 AS from_millis, CASE WHEN event_id % 2 = 0 THEN CAST({START} AS BIGINT) END AS parsed, CAST({START} + event_id AS VARCHAR) AS unix FROM events"
)
def date_coercion(spark, sf_dir):
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.unix_seconds(D.from_number(F.lit(START) + e * 1000)).alias("from_seconds"),
        F.unix_seconds(D.coerce(((F.lit(START) + e * 1000) * 1000).cast("string"))).alias("from_millis"),
        F.unix_seconds(D.parse_date(F.when(e % 2 == 0, "2024-01-01T00:00:00Z").otherwise("never"))).alias("parsed"),
        D.format_since(F.timestamp_seconds(F.lit(START) + e), "unix").alias("unix"),
    )
