"""Ranked lexical search by windowed bucket scoring."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm._shared import materialize, small_batches
from kgspark.llm._text import NON_ALNUM, text_buffers

#: Documents of a window, whose scores are an array of 32 KiB.
WINDOW = 4096
#: Texts of an index part (a longer text is a part of its own), and the most documents that two bytes number.
PART_BYTES, PART_DOCS = 8 << 20, 1 << 16
#: Items are broadcast in blocks of about so many bytes of terms.
BLOCK_BYTES = 8 << 20
#: Length normalisation and saturation, in hundredths and thousandths.
LENGTH, SCALE = 90, 1_000_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PART = "docs long, tokens long, ids binary, known binary, sizes binary, terms binary, ends binary, df binary, at binary, tf binary"
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of some texts, and how many each text has."""
    data = _LOWER[data]
    inside = ~NON_ALNUM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | cut[:-1]))
    end = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | cut[1:])) + 1
    ends = np.concatenate([[0], np.cumsum(end - start)])
    terms = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
    return terms.dictionary_encode(), np.diff(np.searchsorted(start, offsets))


def _part(ids: pa.Array, texts: pa.Array) -> dict:
    """Postings by term of the documents of a part, which are numbered in order of doc_id, nulls last."""
    data, offsets = text_buffers(texts)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    doc = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    order = np.lexsort((doc, ~known))
    number = np.empty(len(doc), np.int64)
    number[order] = np.arange(len(doc))
    terms, sizes = terms_of(data, offsets)
    posting, tf = np.unique(terms.indices.to_numpy().astype(np.int64) * len(doc) + np.repeat(number, sizes), return_counts=True)
    words = terms.dictionary
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    return {
        "docs": int(np.count_nonzero(sizes)),
        "tokens": int(sizes.sum()),
        "ids": doc[order].tobytes(),
        "known": np.packbits(known[order]).tobytes(),
        "sizes": sizes[order].astype("<i8").tobytes(),
        "terms": words.buffers()[2].to_pybytes()[ends[0] : ends[-1]] if len(words) else b"",
        "ends": (ends - ends[0]).astype("<i8").tobytes(),
        "df": np.bincount(posting // len(doc), minlength=len(words)).astype("<i4").tobytes() if len(doc) else b"",
        "at": (posting % max(1, len(doc))).astype("<u2").tobytes(),
        "tf": tf.astype("<i4").tobytes(),
    }


_PART_ARROW = pa.schema([("docs", pa.int64()), ("tokens", pa.int64()), *((n, pa.binary()) for n in ("ids", "known", "sizes", "terms", "ends", "df", "at", "tf"))])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = rows = 0

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        return pa.RecordBatch.from_pylist([_part(table.column(0).combine_chunks(), table.column(1).combine_chunks())], schema=_PART_ARROW)

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            done = int(ends[first - 1]) if first else 0
            last = min(batch.num_rows, first + PART_DOCS - rows, int(np.searchsorted(ends, done + PART_BYTES - size, "right")))
            if last <= first and not rows:
                last = first + 1
            if last > first:
                held.append(batch.slice(first, last - first))
                size, rows, first = size + int(ends[last - 1]) - done, rows + last - first, last
            if rows and (first < batch.num_rows or size >= PART_BYTES or rows >= PART_DOCS):
                yield flush()
                size = rows = 0
    if rows:
        yield flush()


def build_index(docs: DataFrame) -> DataFrame:
    """An index of ``docs`` (doc_id, text): rows of about 8 MiB of text each, with dictionary, lengths and postings.

    It is written to the shared folder, takes one pass without a shuffle, and holds every document: null and empty
    texts without terms, repeated rows as documents of their own, and null doc_ids behind all others. Terms are kept
    as they are, not as hashes. A task holds one part.
    """
    small_batches(docs.sparkSession)
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_build, _PART))


def _dictionary(terms: bytes, ends: bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(ends) // 8 - 1, [None, pa.py_buffer(ends), pa.py_buffer(terms)])


def _frequencies(vocabulary):
    """How many documents of each part hold each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.value), np.int64)
        for batch in batches:
            for terms, ends, df in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = pc.index_in(vocabulary.value, value_set=_dictionary(terms, ends))
                found = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                total[found] += np.frombuffer(df, "<i4")[at.drop_null().to_numpy()]
        has = np.flatnonzero(total)
        yield pa.record_batch([pa.array(has, pa.int32()), pa.array(total[has], pa.int64())], ["term", "n"])

    return run


def length_factor(sizes: np.ndarray, docs: int, tokens: int) -> np.ndarray:
    """100 - LENGTH + (LENGTH * n * N) div L; beyond 64 bits in Python's integers."""
    if LENGTH * int(sizes.max(initial=0)) * docs < 2**63:
        return 100 - LENGTH + LENGTH * sizes * docs // tokens
    return np.array([100 - LENGTH + LENGTH * n * docs // tokens for n in sizes.tolist()], np.int64)


def _harvest(heap: list, k: int, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
    """Put the best of a window's documents on an item's heap, whose first entry is the worst of the best k."""
    if len(heap) == k:
        near = score >= heap[0][0]
        score, ids, known = score[near], ids[near], known[near]
    if len(score) > k:
        best = np.lexsort((ids, ~known, -score))[:k]
        score, ids, known = score[best], ids[best], known[best]
    for entry in zip(score.tolist(), known.tolist(), (-ids).tolist(), strict=True):
        if len(heap) < k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)


def _scorer(asked, k: int):
    """The best k of a task's documents for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weight, items, docs, tokens = asked.value
        heaps: list[list] = [[] for _ in items]
        total, seen = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, bool)
        for batch in batches:
            for ids, known, sizes, terms, ends, df, at, tf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, df, at = np.frombuffer(ids, "<i8"), np.frombuffer(df, "<i4"), np.frombuffer(at, "<u2")
                known = np.unpackbits(np.frombuffer(known, np.uint8), count=len(ids)).astype(bool)
                tf = np.frombuffer(tf, "<i4")
                m = length_factor(np.frombuffer(sizes, "<i8"), docs, tokens)
                number = pc.index_in(vocabulary, value_set=_dictionary(terms, ends)).fill_null(-1).to_numpy(zero_copy_only=False)
                first = np.concatenate([[0], np.cumsum(df, dtype=np.int64)])
                lists = {}
                for v in np.flatnonzero((number >= 0) & (weight > 0)).tolist():
                    where = slice(first[number[v]], first[number[v] + 1])
                    n = tf[where].astype(np.int64)
                    lists[v] = at[where].astype(np.int64), weight[v] * (SCALE * n // (1000 * n + 8 * m[at[where]]))
                for low in range(0, len(ids), WINDOW):
                    part = lists
                    if len(ids) > WINDOW:
                        cut = {v: np.searchsorted(x[0], [low, low + WINDOW]) for v, x in lists.items()}
                        part = {v: (lists[v][0][a:b] - low, lists[v][1][a:b]) for v, (a, b) in cut.items() if a < b}
                    for heap, own in zip(heaps, items, strict=True):
                        for v in own:
                            if v in part:
                                to, add = part[v]
                                total[to] += add
                                seen[to] = True
                        here = np.flatnonzero(seen)
                        if len(here):
                            score = total[here]
                            good = here[score > 0]
                            _harvest(heap, k, total[good], ids[low + good], known[low + good])
                            total[here], seen[here] = 0, False
        rows = [(i, -doc if is_known else None, score) for i, heap in enumerate(heaps) for score, is_known, doc in heap]
        item, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.record_batch([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return run


def search(index: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` documents of highest score for each item: item_id, rank (from 1), doc_id, score.

    ``index``: from :func:`build_index`; ``items``: item_id, text; other columns are ignored, so none can clash. Terms are runs of digits, letters
    and non-ASCII characters, A-Z lower-cased. Weights and scores are as in the query op11: saturating term
    frequencies against document length, in 64-bit integers. Equal scores go by ascending doc_id, a null doc_id last;
    repeated rows of documents rank one by one. Rows of one item_id, null included, are one item with the terms of
    all; an item without terms (or null), an empty index and an empty table of items have no rows.

    A task reads its parts of the index in windows of 4,096 document numbers (in order of doc_id). For each item it
    adds the postings of its terms into an array of a window's scores, flags what it touched, puts the best of the
    flagged ones on the item's heap of ``k`` and clears only those. So a task sends at most ``k`` rows for each item,
    and Spark ranks these. Items go out in blocks of bounded bytes, with a pass over the index for each.
    """
    spark = index.sparkSession
    shape = index.agg(F.sum("docs"), F.sum("tokens")).first()
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = items.select("item_id", F.explode(F.regexp_extract_all(lowered, F.lit(TERMS), F.lit(0))).alias("term")).distinct()
    asked = materialize(terms.groupBy("item_id").agg(F.array_sort(F.collect_list("term")).alias("terms")))
    size = asked.select(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + F.octet_length(t) + 8)).alias("n")).first()["n"] or 0
    kind = items.schema["item_id"].dataType
    blocks = max(1, -(-size // block_bytes))
    found = spark.createDataFrame([], f"item_id {kind.simpleString()}, doc_id long, score long")
    for b in range(blocks if size and shape[0] else 0):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        names = sorted({t for r in rows for t in r["terms"]})
        number = {t: v for v, t in enumerate(names)}
        vocabulary = pa.array([t.encode() for t in names], pa.large_binary())
        sent = spark.sparkContext.broadcast(vocabulary)
        df = dict(index.select("terms", "ends", "df").mapInArrow(_frequencies(sent), "term int, n long").groupBy("term").agg(F.sum("n")).collect())
        weight = np.array([math.floor(1000 * math.log((2 * shape[0] + 2) / (2 * df[v] + 1))) if v in df else 0 for v in range(len(names))], np.int64)
        state = spark.sparkContext.broadcast((vocabulary, weight, [[number[t] for t in r["terms"]] for r in rows], *shape))
        best = index.select("ids", "known", "sizes", "terms", "ends", "df", "at", "tf").mapInArrow(_scorer(state, k), "item int, doc_id long, score long")
        if blocks > 1:
            best = materialize(best)
        sent.unpersist()
        local = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {kind.simpleString()}")
        found = found.union(best.join(F.broadcast(local), "item").select("item_id", "doc_id", "score"))
        if blocks > 1:
            state.unpersist()
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_bucket_search(spark, sf_dir: str) -> DataFrame:
    return search(build_index(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
shape AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM docs WHERE len(t) > 0),
postings AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM postings, shape GROUP BY term, n),
factors AS (SELECT r, doc_id, 10 + (90 * CAST(len(t) AS BIGINT) * n) // l AS m FROM docs, shape WHERE len(t) > 0),
scored AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN factors USING (r) GROUP BY item_id, r, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
