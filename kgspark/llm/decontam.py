"""Benchmark decontamination by a prefix-filtered set join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm._shared import small_batches
from kgspark.llm._text import NON_ALNUM, U, Words, pair, pieces, same_words

WINDOW = 10
#: Items are broadcast in blocks of at most so many bytes of text; a larger benchmark takes several passes.
BLOCK_BYTES = 32 << 20
#: Candidate places that are checked at a time.
SLICE = 1 << 20
HITS = "doc_id long, text_hash long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hash of each two neighbouring words by the first; the last one has none."""
    return np.append(pair(hashes[:-1], hashes[1:]), U(0)) if len(hashes) else hashes


class Windows:
    """The distinct windows of a block of items, and for each the shingle that is rarest in the corpus (its prefix).

    Shingles are pairs of words; a window of one word has that word.
    """

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        w = self.words = Words(*next(iter(_buffers(texts))), NON_ALNUM, True)
        count = np.diff(w.first)
        length = np.minimum(count, window)
        per = np.where(count > 0, count - length + 1, 0)
        item = np.repeat(np.arange(len(ids)), per)
        start = np.repeat(w.first[:-1], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        length = length[item]
        # Equal windows get one number, by the words' numbers.
        number: dict = {}
        one = np.array([number.setdefault(w.data[a:b].tobytes(), len(number)) for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)], np.int64)
        key = length.copy()
        for k in range(int(length.max(initial=0))):
            inside = k < length
            step = np.where(inside, one[np.where(inside, start + k, 0)] + 1, 0)
            key = np.unique(key * (step.max(initial=0) + 1) + step, return_inverse=True)[1]
        _, first, at = np.unique(key, return_index=True, return_inverse=True)
        self.start, self.length = start[first], length[first]
        names: list[set] = [set() for _ in first]
        for window_at, i in zip(at.tolist(), item.tolist(), strict=True):
            names[window_at].add(ids[i])
        self.names = [sorted(n) for n in names]
        self.shingles = shingles(w.hash)
        self.vocabulary = np.unique(np.concatenate([self.shingles, w.hash[start[length == 1]]]))

    def index(self, frequency: np.ndarray) -> tuple:
        """Sorted prefix shingles, the slice of windows of each, and the windows by prefix with its place in each."""
        rank = np.lexsort((self.vocabulary, frequency))
        order = np.empty(len(rank), np.int64)
        order[rank] = np.arange(len(rank))
        best, at = np.full(len(self.start), len(rank), np.int64), np.zeros(len(self.start), np.int64)
        for k in range(max(1, int(self.length.max(initial=0)) - 1)):
            here = np.flatnonzero((k < self.length - 1) | ((k == 0) & (self.length == 1)))
            place = self.start[here] + k
            own = order[np.searchsorted(self.vocabulary, np.where(self.length[here] == 1, self.words.hash[place], self.shingles[place]))] if len(here) else here
            less = own < best[here]
            best[here[less]], at[here[less]] = own[less], k
        prefix = self.vocabulary[rank[best]] if len(best) else np.zeros(0, U)
        by = np.argsort(prefix, kind="stable")
        keys, first = np.unique(prefix[by], return_index=True)
        return keys, np.append(first, len(by)), self.start[by], self.length[by], by, at[by]


def _buffers(texts: list[str | None]):
    data = pa.array([t or "" for t in texts], pa.large_string())
    for _, _, d, o in pieces(data, 1 << 62):
        yield d, o
    if not texts:
        yield np.zeros(0, np.uint8), np.zeros(1, np.int64)


def find(w: Words, words: Words, index: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and window of every occurrence of a window in the words of some texts."""
    keys, first, start, length, number, at = index
    out = [(np.zeros(0, np.int64),) * 3]
    if len(keys) and len(w.hash):
        for probe in (w.hash, shingles(w.hash)):
            k = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
            hit = np.flatnonzero(keys[k] == probe)
            k = k[hit]
            many = first[k + 1] - first[k]
            total = np.cumsum(many)
            done = 0
            while done < len(hit):
                # Some hits at a time, so that the windows of frequent shingles do not all meet in memory.
                upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + SLICE, "right")))
                out.append(_checked(w, words, hit[done:upto], first[k[done:upto]], many[done:upto], start, length, number, at))
                done = upto
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _checked(w: Words, words: Words, hit, first, many, start, length, number, at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    window = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
    begin = np.repeat(hit, many) - at[window]
    # Positional and length bounds: the whole window must lie in the text that holds its prefix.
    owner = np.searchsorted(w.first, np.repeat(hit, many), "right") - 1
    fits = (begin >= w.first[owner]) & (begin + length[window] <= w.first[owner + 1])
    begin, window = begin[fits], window[fits]
    for j in range(int(length[window].max(initial=0))):
        inside = np.flatnonzero(j < length[window])
        wrong = inside[w.hash[begin[inside] + j] != words.hash[start[window[inside]] + j]]
        keep = np.ones(len(begin), bool)
        keep[wrong] = False
        begin, window = begin[keep], window[keep]
    # Equal hashes make candidates; the words themselves decide.
    place = np.arange(length[window].sum()) - np.repeat(np.cumsum(length[window]) - length[window], length[window])
    same = same_words(w, np.repeat(begin, length[window]) + place, words, np.repeat(start[window], length[window]) + place)
    ok = np.bincount(np.repeat(np.arange(len(begin)), length[window]), ~same, len(begin)) == 0
    return begin[ok], length[window[ok]], number[window[ok]]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Find every window of ``window`` consecutive item words that occurs in a document.

    ``docs``: doc_id, text; ``items``: item_id, text; other columns are ignored. Adds no row and drops none: the
    result has one row per document row with n_words, n_hit, spans (word positions, merged, end exclusive) and
    items (sorted ids). Words are lower-cased runs of digits, letters a-z and non-ASCII characters. An item with
    fewer words than a window is one window; one without words (or null) has none. A null item_id counts as "".
    Null texts have no words; empty tables give no rows or no hits.

    A window can only occur where its rarest shingle (two neighbouring words) does, so a first scan counts the items'
    shingles in all documents and a second probes with one shingle per distinct window, checks the bounds and
    verifies all words, letter by letter. Each scan is one pass without a shuffle of texts, about a MiB at a time; a
    longer text is one piece. Items go out in blocks of bounded size (a longer item is a block of its own), one pass
    pair per block.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        rows = part.collect()
        wins = Windows([r[0] for r in rows], [r[1] for r in rows], window)
        vocabulary = spark.sparkContext.broadcast(wins.vocabulary)
        counted = docs.select("text").mapInArrow(_counter(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        frequency = np.zeros(len(wins.vocabulary), np.int64)
        for word, n in counted.collect():
            frequency[word] = n
        index = spark.sparkContext.broadcast((wins.index(frequency), wins.words, wins.names))
        hits = docs.mapInArrow(_prober(index), HITS)
        found = hits if found is None else found.union(hits)
    if blocks > 1:
        found = (
            found.groupBy("doc_id", "text_hash", "n_words")
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.count("*").alias("n"))
            .mapInArrow(_merge_spans, f"{HITS}, n long")
            # Repeated rows have met in one; each pass has brought each of them once.
            .withColumn("n", F.explode(F.sequence(F.lit(1), (F.col("n") / blocks).cast("int"))))
        )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_words", "spans", "items", n_hit.alias("n_hit"))


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite the sorted spans of each row that overlap or touch."""
    for batch in batches:
        merged = []
        for spans in batch.column(3).to_pylist():
            out: list[dict] = []
            for s in spans:
                if out and s["start"] <= out[-1]["end"]:
                    out[-1]["end"] = max(out[-1]["end"], s["end"])
                else:
                    out.append(s)
            merged.append(out)
        yield pa.record_batch([*batch.columns[:3], pa.array(merged, batch.schema.field(3).type), *batch.columns[4:]], batch.schema.names)


def _counter(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        n = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                h = Words(data, offsets, NON_ALNUM, True).hash
                for probe in (h, shingles(h)) if len(known) else ():
                    k = np.minimum(np.searchsorted(known, probe), len(known) - 1)
                    n += np.bincount(np.where(known[k] == probe, k, len(known)), minlength=len(known) + 1)
        some = np.flatnonzero(n[:-1])
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], ["word", "n"])

    return run


def _prober(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, words, windows = shared.value
        for batch in batches:
            for first, last, data, offsets in pieces(batch.column(1)):
                w = Words(data, offsets, NON_ALNUM, True)
                begin, length, number = find(w, words, index)
                spans: list[list] = [[] for _ in range(last - first)]
                names: list[list] = [[] for _ in range(last - first)]
                if len(begin):
                    edge = np.zeros(len(w.hash) + 1, np.int64)
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + length, -1)
                    hit = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
                    cut = np.zeros(len(hit), bool)  # spans end with their text
                    cut[w.first] = True
                    on = np.flatnonzero(hit[1:-1] & (~hit[:-2] | cut[:-2]))
                    off = np.flatnonzero(hit[1:-1] & (~hit[2:] | cut[1:-1])) + 1
                    owner = np.searchsorted(w.first, on, "right") - 1
                    for d, s, e in zip(owner.tolist(), (on - w.first[owner]).tolist(), (off - w.first[owner]).tolist(), strict=True):
                        spans[d].append({"start": s, "end": e})
                    pair = np.unique(np.stack([np.searchsorted(w.first, begin, "right") - 1, number], 1), axis=0)
                    for d, i in pair.tolist():
                        names[d] += windows[i]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(first, last - first),
                        batch.column(2).slice(first, last - first),
                        pa.array(np.diff(w.first), pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array([sorted(set(x)) for x in names], pa.list_(pa.string())),
                    ],
                    ["doc_id", "text_hash", "n_words", "spans", "items"],
                )

    return run


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
wanted AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM wanted WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
runs AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lowered, sizes WHERE len(w) >= n)),
hits AS (SELECT r.doc_id, r.i, r.n, x.item_id FROM runs r JOIN windows x USING (n, win)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(ids.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids.s, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM lowered d LEFT JOIN cover c USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

