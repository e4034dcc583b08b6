"""Near-duplicate documents by min-max hashing, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm._links import components, digests, equal_sets, labelled, own_links, shingle_sets, sizes_allow, texts_of
from kgspark.llm._shared import materialize, small_batches
from kgspark.llm._text import U, draw_key, mix, pieces

#: Similarity of linked documents, in hundredths.
PERCENT = 75
#: Each permutation gives a minimum and a maximum; three permutations make a band of six values. At similarity
#: 0.75 a band agrees with probability 0.18, so all 70 miss with about one in a million (sets of four: one in 10,000).
PERMUTATIONS, PER_BAND = 210, 3

_SEEDS = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=U) * U(0x9E3779B97F4A7C15))
_XOR, _MUL = _SEEDS[:PERMUTATIONS], _SEEDS[PERMUTATIONS:] | U(1)


def min_max(s: np.ndarray, block: int = 2048) -> np.ndarray:
    """Band keys of a set: both extremes of each permutation, three permutations a band."""
    low, high = np.full(PERMUTATIONS, np.iinfo(U).max, U), np.zeros(PERMUTATIONS, U)
    for k in range(0, len(s), block):
        x = (s[k : k + block, None] ^ _XOR) * _MUL
        np.minimum(low, x.min(0), out=low)
        np.maximum(high, x.max(0), out=high)
    key = np.arange(PERMUTATIONS // PER_BAND, dtype=U)
    for extreme in (low, high):
        for v in extreme.reshape(-1, PER_BAND).T:
            key = mix(key * U(0xD6E8FEB86659FD93) + v)
    return key


def _sketches(key: int):
    """Size and digest of each text's set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in pieces(batch.column(1)):
                sets = shingle_sets(data, offsets, key)
                bands = [min_max(s).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
                lengths = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array([len(s) for s in sets], pa.int64()),
                        *digests(sets),
                        pa.array(np.diff(offsets)),
                        pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate([np.zeros(0, np.int64), *bands]))),
                    ],
                    ["doc_id", "n_shingles", "digest", "digest2", "bytes", "bands"],
                )

    return run


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Group documents whose sets of five-word shingles are linked at 0.75 or more, directly or over others.

    ``docs``: doc_id, text. Returns doc_id, n_shingles, component_id (the smallest doc_id reachable), kept. Words
    are split at white space after A-Z are lower-cased. A text with fewer than five words is one shingle; a null or
    empty text has an empty set and is linked with nothing. Repeated rows of one doc_id give one row each; they
    share a component when any row links. Rows with a null doc_id come back with a null component and are kept.

    Equal sets are merged first (one representative per class), so copies never meet in a bucket; sets count as equal
    when their sizes and 128-bit digests are, the words being hashed under a key drawn for the run. Each document is
    first compared with the smallest one that it shares a bucket with. Then, only where a bucket still spans several
    components, its documents are compared across components: pair by pair in a small bucket, in blocks in a large
    one, of buckets with the same documents only once. Every link is confirmed on the full sets, word by word. Thus no
    pair that shares a bucket goes unexamined unless it is already connected, and the pairs within a group are never
    expanded to rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = materialize(docs.mapInArrow(_sketches(draw_key()), "doc_id long, n_shingles long, digest long, digest2 long, bytes long, bands array<long>"))
    member, reps = equal_sets(sketch)
    rows = reps.select("id", F.col("n_shingles").alias("size"), "bytes", F.explode("bands").alias("key"))
    hubs = materialize(rows.groupBy("key").agg(F.min(F.struct("id", "size")).alias("hub"), F.count("*").alias("n")).where("n > 1"))
    bucket = materialize(rows.join(hubs, "key"))

    texts = texts_of(docs, bucket.select("id"))
    first = bucket.where((F.col("hub.id") != F.col("id")) & sizes_allow(F.col("hub.size"), F.col("size"), PERCENT)).groupBy(F.col("id").alias("b")).agg(F.min("hub.id").alias("a"))
    comp = components(first, bucket.drop("hub"), own_links(member), texts, PERCENT)
    return labelled(sketch, member, comp).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_minmax_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM lowered WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 75 * (p.n + q.n - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(src, dst) AS (SELECT a, b FROM both_ways UNION SELECT r.src, e.b FROM reach r JOIN both_ways e ON e.a = r.dst),
low AS (SELECT src, min(dst) AS m FROM reach GROUP BY src)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM lowered d LEFT JOIN sizes s USING (doc_id) LEFT JOIN low ON low.src = d.doc_id
"""
