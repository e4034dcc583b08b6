"""Chunking of contents and the index of chunk, entity and relationship vectors."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.ids import embedding_checksum
from kgspark.functions.text import content_text, entity_text, let, trim
from kgspark.operators.records import needs_reembedding

SIZE, OVERLAP = 2000, 200


#: Code points of the slices of a text in which chunks are looked up.
_SLICE = 1 << 16


def chunk(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Chunks of a text (E8): array of index, text, start, end.

    Paragraphs are packed, joined by a space, until the next would pass ``size``; a new chunk starts with the last
    ``overlap`` characters of the one before. A longer paragraph is not split. Offsets are in the re-joined text.
    The fold runs over the paragraphs' lengths only; each chunk is then cut out once, from the slices it lies in.
    """
    span = "array<struct<start:int,end:int>>"
    none = F.array().cast(span)

    def step(s, n):
        long = s["end"] - s["start"]
        full = long + n + 1 > size
        start = F.when(full & (long > 0), s["end"] - F.least(F.lit(overlap), long)).otherwise(s["start"])
        done = F.when(full & (long > 0), F.concat(s["done"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["done"])
        return F.struct(done.alias("done"), start.alias("start"), (s["end"] + F.when(long > 0, 1).otherwise(0) + n).alias("end"))

    def cut(s):
        first = F.get(s["parts"], F.lit(0)) == ""
        parts = F.when(first, F.slice(s["parts"], 2, 1 << 30)).otherwise(s["parts"])
        slices = F.regexp_extract_all(F.array_join(parts, " "), F.lit(f"(?s).{{1,{_SLICE}}}"), F.lit(0))
        folded = F.aggregate(F.transform(s["parts"], F.length), F.struct(none.alias("done"), F.lit(0).alias("start"), F.lit(0).alias("end")), step)
        last = F.array(F.struct(folded["start"].alias("start"), folded["end"].alias("end")))
        return F.struct(slices.alias("slices"), F.concat(folded["done"], F.when(folded["end"] > folded["start"], last).otherwise(none)).alias("spans"))

    def taken(s):
        def one(c, i):
            at = F.floor(c["start"] / _SLICE).cast("int")
            near = F.array_join(F.slice(s["slices"], at + 1, F.floor((c["end"] - 1) / _SLICE).cast("int") - at + 1), "")
            return F.struct(i.alias("index"), trim(F.substring(near, c["start"] - at * _SLICE + 1, c["end"] - c["start"])).alias("text"), c["start"].alias("start"), c["end"].alias("end"))

        return F.transform(s["spans"], one)

    many = let(let(F.struct(F.split(text, r"\n\n+").alias("parts")), cut), taken)
    one = F.array(F.struct(F.lit(0).alias("index"), text.alias("text"), F.lit(0).alias("start"), F.length(text).alias("end")))
    return F.when(F.length(text) <= size, one).otherwise(many)


def chunk_records(records: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """A row per chunk of each record's text for embedding (I7): record_id, checksum, index, text, start, end."""
    text = content_text(F.col("_id"), F.col("title"), F.col("content"))
    return records.select(F.col("_id").alias("record_id"), "checksum", F.explode(chunk(text, size, overlap)).alias("c")).select("record_id", "checksum", "c.*")


def hashed_embedder(dim: int = 64) -> Callable[[pd.Series], list[np.ndarray]]:
    """A stand-in for an embedding model: signed feature hashing of words, of unit length."""

    def embed(texts: pd.Series) -> list[np.ndarray]:
        words = [t.lower().split() if t else [] for t in texts]
        number: dict = {}
        at = np.array([number.setdefault(w, len(number)) for ws in words for w in ws], np.int64)
        h = np.array([zlib.crc32(w.encode()) for w in number], np.int64)
        row = np.repeat(np.arange(len(words)), [len(ws) for ws in words])
        out = np.zeros((len(words), dim))
        if len(at):
            flat = np.bincount(row * dim + (h % dim)[at], np.where(h >> 31, 1.0, -1.0)[at], len(words) * dim)
            out = flat.reshape(-1, dim)
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return list((out / np.where(norm == 0, 1, norm)).astype(np.float32))

    return embed


#: Texts that an embedder gets at a time: its words of a whole Arrow batch would fill a worker's memory.
_TEXTS = 500


def embed(rows: DataFrame, text: str, embedder: Callable[[pd.Series], list] | None = None) -> DataFrame:
    """Add ``embedding`` by a batch embedder."""
    embedder = embedder or hashed_embedder()
    schema = rows.select("*", F.array(F.lit(0.0).cast("float")).alias("embedding")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(embedding=[e for i in range(0, len(b), _TEXTS) for e in embedder(b[text].iloc[i : i + _TEXTS])])

    return rows.mapInPandas(run, schema)


def index_vectors(vectors: DataFrame, changed: DataFrame, embedder: Callable | None = None) -> DataFrame:
    """Vectors after re-indexing changed records (I7, A23): outdated chunks go, new ones come."""
    fresh = embed(chunk_records(changed), "text", embedder).select(
        F.concat_ws("#", "record_id", "index").alias("id"), F.lit("chunk").alias("type"), "record_id", "checksum", F.col("index").alias("chunk_index"), "embedding"
    )
    stale = changed.select(F.col("_id").alias("record_id"), F.col("checksum").alias("_now"))
    kept = vectors.join(stale, "record_id", "left").where(F.col("_now").isNull()).select(*vectors.columns)
    return kept.unionByName(fresh, allowMissingColumns=True)


def outdated(vectors: DataFrame, records: DataFrame) -> DataFrame:
    """Chunk vectors whose record now has another checksum."""
    now = records.select(F.col("_id").alias("record_id"), F.col("checksum").alias("_now"))
    return vectors.where(F.col("type") == "chunk").join(now, "record_id").where(~F.col("checksum").eqNullSafe(F.col("_now"))).drop("_now")


def embedding_state(metadata: DataFrame) -> DataFrame:
    """Metadata with the checksum of what would be embedded."""
    return metadata.withColumn("content_checksum", embedding_checksum(text=F.col("name"), entityType=F.col("type"), description=F.col("description")))


def refresh_embeddings(metadata: DataFrame, embedder: Callable | None = None) -> DataFrame:
    """Metadata (id, name, type, description, embedded_checksum) whose content changed, embedded anew."""
    stale = needs_reembedding(embedding_state(metadata))
    fresh = embed(stale.withColumn("text", entity_text(F.col("type"), F.col("name"), F.col("description"))), "text", embedder)
    return fresh.select("id", "embedding", F.col("content_checksum").alias("embedded_checksum"))
