"""Phrases of a corpus without a tagger: runs of words that hold together and stand in many places.

Two measures decide. Cohesion: how much oftener the words stand together than their own counts make likely, at the
weakest place of the phrase. Freedom: the entropy of the words before and after it, for a part of a longer fixed phrase
is always followed by the same word.

Texts are split into words once. A run can only be frequent if its shorter runs are, so each pass counts the runs whose
shorter ones are in a sieve: a map of bits of bounded size that holds all frequent ones and lets some others through.
Most pairs of frequent words are rare; they are sifted out by sums over 32 bits of their hashes. What passes is counted
by its words, so a sieve changes no result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from kgspark.session import written

BETWEEN = r"\P{L}+"
#: Rows of an Arrow batch (texts are long rows), and bytes of words that a task looks at together; a longer text is looked at alone.
BATCH_ROWS, PIECE = 1024, 4 << 20
#: Bits of a sieve for each run in it, bits of one of its pages, and of all (powers of two).
SIEVE_BITS, PAGE_BITS, MOST_BITS = 16, 1 << 15, 1 << 27
#: Phrases up to this number are sent to all tasks, more are joined by shuffle.
FEW = 100_000
#: Words for each part that sums of pairs are dealt to, and the fewest and most parts.
PART_WORDS, PARTS = 1 << 20, (64, 4096)
_U = np.uint64


def _dealt(docs: DataFrame) -> DataFrame:
    """``docs`` in tasks for all cores, where few parts of the input hold all rows."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    filled = docs.groupBy(F.spark_partition_id()).count().limit(cores).count()
    return docs if filled >= cores else docs.repartition(4 * cores)


def split(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The words of each text that has any: its runs of letters, lower-cased, joined by spaces (``words``), beside the columns ``keep``; written once."""
    words = F.trim(F.regexp_replace(F.lower("words"), F.lit(BETWEEN), F.lit(" ")))
    rows = _dealt(docs.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("words")))
    _small_batches(docs.sparkSession)
    return written(rows.withColumn("words", words)).where("words <> ''")


def _small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session have at most BATCH_ROWS rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def _mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a run and the word after it."""
    h = (h ^ (h >> _U(29))) * _U(0x9E3779B97F4A7C15) + word
    return h ^ (h >> _U(32))


def _word_hash(texts: pa.Array) -> np.ndarray:
    """A hash of each word: of its length and its first 24 bytes."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    size = np.diff(offsets)
    padded = np.concatenate([np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), np.zeros(24, np.uint8)])
    h = size.astype(_U)
    for k in (0, 8, 16):
        eight = padded[offsets[:-1, None] + np.arange(k, k + 8)] * (np.arange(k, k + 8) < size[:, None])
        h = _mixed(h, np.ascontiguousarray(eight.astype(np.uint8)).view(_U)[:, 0])
    return _mixed(h, h)


def _within(sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h >> _U(65 - (8 * len(sieve)).bit_length())
    return (sieve[bit >> _U(3)] >> (bit & _U(7)).astype(np.uint8)) & 1 == 1


class Words:
    """The words of some texts, one after another: ``code`` of each (its place in ``texts``), ``start`` and ``end`` of the text it is in, ``row`` of that text."""

    def __init__(self, texts: pa.Array):
        words = pc.split_pattern(texts, " ")
        coded = words.flatten().dictionary_encode()
        self.texts, self.code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        ends = np.cumsum(pc.list_value_length(words).to_numpy().astype(np.int64))
        self.row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        self.start, self.end = np.append(0, ends)[self.row], ends[self.row]
        self.hash = _word_hash(self.texts)

    def places(self, n: int, sieves: dict[int, np.ndarray]) -> np.ndarray:
        """Where runs of ``n`` words start that pass the sieves: those of each length, on every run of that length in them."""
        at = np.arange(len(self.code))
        h = self.hash[self.code]
        for k in range(1, n + 1):
            if k > 1:
                # Both shorter runs of a run have passed: that at its start, and that at the next place.
                going = np.zeros(len(self.code) + 1, bool)
                going[at] = True
                of = going[at + 1] & (at + k <= self.end[at])
                at, h = at[of], h[of]
                h = _mixed(h, self.hash[self.code[at + k - 1]])
            if k in sieves:
                of = _within(sieves[k], h)
                at, h = at[of], h[of]
        return at

    def different(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The different runs of ``n`` words among those that start ``at``: the place of one of each, and which each is."""
        which = self.code[at]
        for k in range(1, max(n, 2)):
            which, found = pd.factorize(which if n == 1 else which * len(self.texts) + self.code[at + k])
        one = np.empty(len(found), np.int64)
        one[which] = at
        return one, which

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the runs of ``n`` words that start ``at``."""
        h = self.hash[self.code[at]]
        for k in range(1, n):
            h = _mixed(h, self.hash[self.code[at + k]])
        return h

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """The texts of the runs that start ``at``."""
        return pc.binary_join_element_wise(*[self.texts.take(pa.array(self.code[at + k])) for k in range(n)], " ").cast(pa.string())

    def beside(self, at: np.ndarray, step: int) -> np.ndarray:
        """Code of the word ``step`` places on, the number of ``texts`` where the text has none."""
        to = at + step
        there = (to >= self.start[at]) & (to < self.end[at])
        return np.where(there, self.code[np.clip(to, 0, len(self.code) - 1)], len(self.texts))


def _pieces(column: pa.Array) -> Iterator[tuple[int, Words]]:
    """The texts of a column, about PIECE bytes at a time, with the first one's row."""
    ends, first = np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64)), 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PIECE, "right")))
        yield first, Words(column.slice(first, last - first))
        first = last


def _counted(n: int, sieves) -> Callable:
    """How often each run of ``n`` words stands in a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, w in _pieces(batch.column(0)):
                one, which = w.different(w.places(n, sieves.value), n)
                yield pa.record_batch([w.phrases(one, n), pa.array(np.bincount(which, minlength=len(one)))], ["phrase", "n"])

    return run


def _neighbours(lengths: range, sieves) -> Callable:
    """How often each word stands before and after each run that is in the sieve of its length (empty at the ends of a text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, w in _pieces(batch.column(0)):
                texts = pa.concat_arrays([w.texts, pa.array([""], w.texts.type)])
                for n in lengths:
                    at = w.places(n, {n: sieves.value[n]})
                    one, which = w.different(at, n)
                    for side, step in (("before", -1), ("after", n)):
                        pair, c = np.unique(which * len(texts) + w.beside(at, step), return_counts=True)
                        yield pa.record_batch([w.phrases(one[pair // len(texts)], n), pa.array([side] * len(pair), pa.string()), texts.take(pa.array(pair % len(texts))).cast(pa.string()), pa.array(c)], ["phrase", "side", "word", "c"])

    return run


def _first_places(key: str, lengths: range, sieves) -> Callable:
    """Where each run that is in the sieve of its length first stands in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, w in _pieces(batch.column(1)):
                for n in lengths:
                    at = w.places(n, {n: sieves.value[n]})
                    one, which = w.different(at, n)
                    at = at[~pd.Series(w.row[at] * max(len(one), 1) + which).duplicated().to_numpy()]
                    place = (at - w.start[at] + 1).astype(np.int32)
                    yield pa.record_batch([batch.column(0).take(pa.array(first + w.row[at])), w.phrases(at, n), pa.array(place), pa.array(np.full(len(at), -n, np.int32))], [key, "phrase", "at", "n"])

    return run


def _slots(phrases: DataFrame, n: int) -> DataFrame:
    """The slot, 32 bits of the hash, of every phrase of ``n`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = Words(batch.column(0))
                yield pa.record_batch([pa.array((w.hashes(np.arange(batch.num_rows) * n, n) >> _U(32)).astype(np.int64))], ["slot"])

    return phrases.select("phrase").mapInArrow(run, "slot long")


def _summed(n: int, parts: int, sieves) -> Callable:
    """Slots of the runs of ``n`` words of a piece and how often each stands there (65,535 at most), packed, a row for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, w in _pieces(batch.column(0)):
                one, which = w.different(w.places(n, sieves.value), n)
                slot = (w.hashes(one, n) >> _U(32)).astype(np.uint32)
                c = np.minimum(np.bincount(which, minlength=len(one)), 0xFFFF).astype(np.uint16)
                order = np.argsort(slot)
                slot, c = slot[order], c[order]
                part, at = np.unique((slot.astype(_U) * _U(parts) >> _U(32)).astype(np.int32), return_index=True)
                cut = lambda x: pa.array([y.tobytes() for y in np.split(x, at[1:])] if len(part) else [], pa.binary())
                yield pa.record_batch([pa.array(part), cut(slot), cut(c)], ["part", "slots", "counts"])

    return run


def _often(least: int) -> Callable:
    """The slots of a part that are found ``least`` times."""

    def run(rows: pa.Table) -> pa.Table:
        slot, c = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in rows.column(k)]) for k, kind in (("slots", np.uint32), ("counts", np.uint16)))
        order = np.argsort(slot)
        slot, c = slot[order], c[order]
        at = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        return pa.table([pa.array(slot[at][np.add.reduceat(c, at, dtype=np.int64) >= min(least, 0xFFFF)].astype(np.int64))], ["slot"])

    return run


def _sieve(slots: DataFrame) -> np.ndarray:
    """A map of bits in which the bits of all ``slots`` are set; at most MOST_BITS reach the driver, in pages."""
    bits = max(PAGE_BITS, min(MOST_BITS, 1 << (SIEVE_BITS * slots.count()).bit_length()))
    bit = F.shiftright("slot", 33 - bits.bit_length())
    out = np.zeros(bits // 8, np.uint8)
    for page, found in slots.select(F.floor(bit / PAGE_BITS).cast("int").alias("page"), F.pmod(bit, F.lit(PAGE_BITS)).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit")).collect():
        out[page * PAGE_BITS // 8 : (page + 1) * PAGE_BITS // 8] = np.frombuffer(bytes(found), np.uint8)
    return out


@F.pandas_udf(DoubleType())
def _log2(x: pd.Series) -> pd.Series:
    """Logarithms as the C library rounds them: Spark's quotient of two logarithms is off in the last digit, which decides at a threshold."""
    return pd.Series([math.log2(v) for v in x], dtype=float)


def _entropy(beside: DataFrame, side: str) -> DataFrame:
    """Entropy of the words on one side of each phrase, in bits, from counts of pairs."""
    s = beside.where(F.col("side") == side).groupBy("phrase").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("l")).alias("s"))
    return s.select("phrase", (_log2(F.col("n").cast("double")) - F.col("s") / F.col("n")).alias(f"h_{side}"))


def mined(docs: DataFrame, text: str = "text", longest: int = 3, least: int = 10, cohesion: float = 4.0, freedom: float = 1.0, words: DataFrame | None = None) -> DataFrame:
    """Phrases of two to ``longest`` words: phrase, n (how often), cohesion and freedom (both in bits).

    A phrase is kept if it occurs ``least`` times, holds together by ``cohesion`` bits and both its sides have ``freedom``
    bits of entropy. Nulls and texts of one word have none; each row of a repeated text counts. ``words``: what ``split``
    gives for ``docs``, where it is there already.
    """
    spark = docs.sparkSession
    texts = (split(docs, text=text) if words is None else words).select("words")
    sieves: dict[int, np.ndarray] = {}
    frequent: dict[int, DataFrame] = {}
    tight: dict[int, DataFrame] = {}
    for n in range(1, longest + 1):
        if n == 2:
            shared = spark.sparkContext.broadcast(sieves)
            parts = min(max(total // PART_WORDS, PARTS[0]), PARTS[1])
            sums = texts.mapInArrow(_summed(n, parts, shared), "part int, slots binary, counts binary")
            sieves = sieves | {n: _sieve(written(sums.groupBy("part").applyInArrow(_often(least), "slot long")))}
        shared = spark.sparkContext.broadcast(sieves)
        c = texts.mapInArrow(_counted(n, shared), "phrase string, n long").groupBy("phrase").agg(F.sum("n").alias("n"))
        if n == 1:
            c = written(c)
            total = c.agg(F.sum("n")).first()[0] or 0
            frequent[n] = c = c.where(F.col("n") >= least)
        else:
            frequent[n] = c = written(c.where(F.col("n") >= least))
        if n not in sieves and n < longest:
            sieves = sieves | {n: _sieve(_slots(c, n))}
        if n == 1:
            continue
        # Each frequent phrase's parts are frequent, so all are found.
        ends = {"first": (1, 1), "last": (1, -1), "head": (n - 1, n - 1), "tail": (n - 1, 1 - n)}
        parted = c.withColumns({k: F.substring_index("phrase", " ", at) for k, (_, at) in ends.items()})
        for k, (size, _) in ends.items():
            parted = parted.join(frequent[size].select(F.col("phrase").alias(k), F.col("n").alias(f"n_{k}")), k)
        bits = lambda a, b: _log2(F.col("n") * F.lit(float(total)) / (F.col(a).cast("double") * F.col(b)))
        tight[n] = written(parted.select("phrase", "n", F.least(bits("n_first", "n_tail"), bits("n_head", "n_last")).alias("cohesion")).where(F.col("cohesion") >= cohesion))
    lengths = range(2, longest + 1)
    shared = spark.sparkContext.broadcast({n: _sieve(_slots(tight[n], n)) for n in lengths})
    found = _all(tight)
    beside = texts.mapInArrow(_neighbours(lengths, shared), "phrase string, side string, word string, c long")
    beside = written(beside.groupBy("phrase", "side", "word").agg(F.sum("c").alias("c")).withColumn("l", _log2(F.col("c").cast("double"))))
    shared.unpersist()
    # What a sieve let through beside the tight phrases goes here.
    found = found.join(_entropy(beside, "before"), "phrase").join(_entropy(beside, "after"), "phrase")
    return found.select("phrase", "n", "cohesion", F.least("h_before", "h_after").alias("freedom")).where(F.col("freedom") >= freedom)


def _all(tables: dict[int, DataFrame]) -> DataFrame:
    out, *others = tables.values()
    for t in others:
        out = out.union(t)
    return out


def phrases_in(docs: DataFrame, key: str, phrases: DataFrame, text: str = "text", longest: int = 3, words: DataFrame | None = None) -> DataFrame:
    """The phrases of each text that has any, in the order of their first places, longer ones first: ``key``, phrases (``words``: what ``split`` gives for ``docs`` with ``key``)."""
    known = written(phrases.select("phrase").distinct())
    stated = F.broadcast(known) if known.count() <= FEW else known
    lengths = range(2, longest + 1)
    size = F.size(F.split("phrase", " "))
    shared = docs.sparkSession.sparkContext.broadcast({n: _sieve(_slots(known.where(size == n), n)) for n in lengths})
    kind = StructType([StructField(key, docs.schema[key].dataType), StructField("phrase", StringType()), StructField("at", IntegerType()), StructField("n", IntegerType())])
    rows = split(docs, key, text=text) if words is None else words
    found = rows.select(key, "words").mapInArrow(_first_places(key, lengths, shared), kind).join(stated, "phrase", "left_semi").groupBy(key, "phrase", "n").agg(F.min("at").alias("at"))
    return found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n", "phrase"))), lambda x: x["phrase"]).alias("phrases"))
