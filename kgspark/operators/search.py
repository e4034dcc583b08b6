"""Retrieval: vector top-k and the five query modes, for one request or a batch of them, each one lazy DataFrame.

Tables: ``vectors`` (id, type, embedding, record_id, entity_id, source_entity_id, target_entity_id, rel_type,
confidence), ``metadata`` (entity_id, source_record_ids), ``records`` (_id, source, record_type, title, content),
``edges`` between record ids (src, dst, type, confidence). All requests of a batch share one scan of the vectors, in
which each task keeps its best rows of each search; everything after it carries the request's number in ``query``.
Hit sets have at most top_k rows of each search; what is joined to them may be large and is joined by shuffle unless
its size says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.dates import half_up
from kgspark.functions.text import let, snippet


@dataclass
class Tables:
    vectors: DataFrame
    metadata: DataFrame
    records: DataFrame
    edges: DataFrame


@dataclass
class Request:
    """A query; vectors are those of its text, and of its specific and its thematic keywords."""

    vector: list[float]
    low: list[float]
    high: list[float]
    text: str = ""
    mode: str = "mix"
    top_k: int = 60
    chunk_top_k: int = 20
    threshold: float = 0.3


@dataclass
class Search:
    """One vector search of a batch: the ``k`` nearest of a type at or over a threshold, for request ``query``."""

    slot: str
    query: int
    vector: list[float]
    k: int
    threshold: float
    kind: str


_HIT = ["id", "record_id", "entity_id", "source_entity_id", "target_entity_id", "rel_type", "confidence"]
#: Rows that are scored together, and how far a score of the product may be from the row's own.
_ROWS, _MARGIN = 4096, 1e-9


def nearest(vectors: DataFrame, searches: list[Search]) -> DataFrame:
    """Hits of each search by cosine, ties by id (F1): slot, query, score and the vectors' columns but the embedding.

    A task keeps no more than ``k`` rows of each search. One product of a slice of rows and all searches' vectors finds
    the rows that may be among them, by a margin over its rounding; only those are scored row by row, so a score never
    depends on what else was searched. Vectors that are null, zero or of another length are no hits.
    """
    columns = [c for c in _HIT if c in vectors.columns]
    wanted = [(s, np.asarray(s.vector, float)) for s in searches]
    by_size: dict[int, list[int]] = {}
    for i, (_, v) in enumerate(wanted):
        if v.any():
            by_size.setdefault(len(v), []).append(i)

    def best(table: pa.Table, k: int) -> pa.Table:
        return table.take(pc.sort_indices(table, [("score", "descending"), ("id", "ascending")])[:k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, pa.Table] = {}
        least = np.array([s.threshold for s, _ in wanted])
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                part = pa.Table.from_batches([batch.slice(first, _ROWS)])
                embedding = part.column("embedding").combine_chunks()
                length = pc.fill_null(pc.list_value_length(embedding), -1).to_numpy(zero_copy_only=False)
                for size, own in by_size.items():
                    at = np.flatnonzero(length == size)
                    e = embedding.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), size)
                    norm = np.sqrt((e * e).sum(1))
                    rows, kinds = part.select(columns).take(pa.array(at)), part.column("type").take(pa.array(at))
                    of_kind = {k: pc.fill_null(pc.equal(kinds, k), False).to_numpy(zero_copy_only=False) for k in {wanted[i][0].kind for i in own}}
                    v = np.stack([wanted[i][1] for i in own])
                    with np.errstate(invalid="ignore", divide="ignore"):
                        about = (e @ v.T) / (norm[:, None] * np.sqrt((v * v).sum(1)))
                    near = about >= least[own] - _MARGIN
                    for j in np.flatnonzero(near.any(0)).tolist():
                        i = own[j]
                        s, vector = wanted[i]
                        ok = np.flatnonzero(near[:, j] & of_kind[s.kind])
                        if len(ok) > s.k > 0:
                            ok = ok[about[ok, j] >= np.partition(about[ok, j], len(ok) - s.k)[len(ok) - s.k] - _MARGIN]
                        score = (e[ok] * vector).sum(1) / (norm[ok] * np.sqrt((vector * vector).sum()))
                        ok, score = ok[score >= s.threshold], score[score >= s.threshold]
                        if len(ok):
                            found = rows.take(pa.array(ok)).append_column("score", pa.array(score))
                            kept[i] = best(pa.concat_tables([kept[i], found]) if i in kept else found, s.k)
                            if len(kept[i]) == s.k > 0:
                                least[i] = max(least[i], kept[i].column("score")[s.k - 1].as_py())
        for i, found in kept.items():
            s = wanted[i][0]
            n = len(found)
            found = found.append_column("slot", pa.array([s.slot] * n)).append_column("query", pa.array([s.query] * n, pa.int32())).append_column("k", pa.array([s.k] * n, pa.int32()))
            yield from found.combine_chunks().to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in columns), "score double", "slot string", "query int", "k int"])
    hits = vectors.select(*columns, "type", "embedding").mapInArrow(run, schema)
    w = Window.partitionBy("slot", "query").orderBy(F.desc("score"), "id")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n <= k").drop("_n", "k")


def top_k(vectors: DataFrame, query: list[float], k: int, threshold: float, kind: str, where: Column | None = None) -> DataFrame:
    """The k nearest vectors of a type by cosine at or over a threshold, ties by id (F1), of those that fit a condition."""
    return nearest(vectors if where is None else vectors.where(where), [Search("", 0, query, k, threshold, kind)]).drop("slot", "query")


_COLUMNS = ["_id", "source", "record_type", "title", "content"]


def searches(requests: list[Request]) -> list[Search]:
    """The vector searches that the requests' modes need."""
    out = []
    for i, r in enumerate(requests):
        if r.mode == "naive":
            out.append(Search("chunk", i, r.vector, r.chunk_top_k, r.threshold, "chunk"))
        if r.mode in ("local", "hybrid", "mix"):
            out.append(Search("entity", i, r.low, r.top_k, r.threshold, "entity"))
            if r.top_k // 2:
                out.append(Search("low", i, r.low, r.top_k // 2, r.threshold, "relationship"))
        if r.mode in ("global", "hybrid", "mix"):
            out.append(Search("high", i, r.high, r.top_k, r.threshold, "relationship"))
    return out


def entity_records(hits: DataFrame, metadata: DataFrame) -> DataFrame:
    """Records behind entity hits, each with its best score (C2, D22): query, id, score."""
    found = hits.where(F.col("slot") == "entity").select("query", "entity_id", "score").join(metadata, "entity_id")
    return found.select("query", F.explode("source_record_ids").alias("id"), "score").groupBy("query", "id").agg(F.max("score").alias("score"))


def hit_relationships(hits: DataFrame, metadata: DataFrame, slot: str) -> DataFrame:
    """Edges between the first records of relationship hits' ends (C3): query, src, dst, type, confidence, hit."""
    named = hits.where(F.col("slot") == slot)
    first = metadata.select("entity_id", F.try_element_at("source_record_ids", F.lit(1)).alias("record"))
    s = first.withColumnsRenamed({"entity_id": "source_entity_id", "record": "s"})
    d = first.withColumnsRenamed({"entity_id": "target_entity_id", "record": "d"})
    return named.join(s, "source_entity_id", "left").join(d, "target_entity_id", "left").select(
        "query", F.coalesce("s", "source_entity_id").alias("src"), F.coalesce("d", "target_entity_id").alias("dst"), F.col("rel_type").alias("type"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("id").alias("hit")
    )


def records_of_entities(t: Tables, query: list[float], k: int, threshold: float) -> DataFrame:
    """Records behind the nearest entities, each with its best score: id, score."""
    return entity_records(nearest(t.vectors, [Search("entity", 0, query, k, threshold, "entity")]), t.metadata).drop("query")


def relationships_of_query(t: Tables, query: list[float], k: int, threshold: float) -> DataFrame:
    """Edges of the nearest relationships by confidence (F3): src, dst, type, confidence."""
    rows = hit_relationships(nearest(t.vectors, [Search("high", 0, query, k, threshold, "relationship")]), t.metadata, "high")
    return rows.orderBy(F.desc("confidence"), "hit").limit(k).select("src", "dst", "type", "confidence")


def _ends(edges: DataFrame) -> DataFrame:
    """Both ends of edges with their confidence: query, id, score."""
    score = F.coalesce("confidence", F.lit(0.0)).alias("score")
    return edges.select("query", F.col("src").alias("id"), score).union(edges.select("query", F.col("dst").alias("id"), score))


def local_candidates(t: Tables, hits: DataFrame) -> DataFrame:
    """Ids around the entities named in requests (I3): only those with an edge; keywords' edges only score. query, id, score."""
    entities = entity_records(hits, t.metadata)
    ids = entities.select("query", "id")
    edges = t.edges.select("src", "dst", "confidence")
    around = _ends(edges.join(ids.withColumnRenamed("id", "src"), "src").unionByName(edges.join(ids.withColumnRenamed("id", "dst"), "dst")))
    # An id counts if an edge around the entities ends there (D21: the highest of all its scores).
    rows = around.withColumn("near", F.lit(True)).union(entities.select("query", "id", "score", F.lit(False))).union(_ends(hit_relationships(hits, t.metadata, "low")).withColumn("near", F.lit(False)))
    return rows.groupBy("query", "id").agg(F.max("score").alias("score"), F.max("near").alias("near")).where("near").drop("near")


def global_candidates(t: Tables, hits: DataFrame) -> DataFrame:
    """Ids at the ends of the relationships that requests' themes suggest (I4): query, id, score."""
    return _ends(hit_relationships(hits, t.metadata, "high")).groupBy("query", "id").agg(F.max("score").alias("score"))


def naive_candidates(t: Tables, hits: DataFrame) -> DataFrame:
    """Records of the nearest chunks, each with its best (I2): query, id, score."""
    return hits.where(F.col("slot") == "chunk").groupBy("query", F.col("record_id").alias("id")).agg(F.max("score").alias("score"))


def first_wins(rows: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _of(requests: list[Request], field: str, query: Column) -> Column:
    """A request's number of rows, by its place."""
    return F.element_at(F.split(F.lit(",".join(str(getattr(r, field)) for r in requests)), ",").cast("array<int>"), query + 1)


def answer(t: Tables, requests: list[Request], scorer: Callable[[Column, Column], Column] | None = None, least: float | None = None) -> DataFrame:
    """Answer requests (I1-I6): query (the request's place in the list), score and the records' columns, no order.

    Hybrid and mix take local before global results, the first of each record, and cut without sorting anew (G3, F5).
    Mix results are scored again by ``scorer`` (text, query); without one they stay as they are (F6).
    """
    hits = nearest(t.vectors, searches(requests))
    modes = {r.mode for r in requests}
    mode = F.element_at(F.split(F.lit(",".join(r.mode for r in requests)), ","), F.col("query") + 1)
    parts = []
    if "naive" in modes:
        parts.append(naive_candidates(t, hits).withColumn("_m", F.lit(0)))
    if modes & {"local", "hybrid", "mix"}:
        parts.append(local_candidates(t, hits).withColumn("_m", F.lit(0)))
    if modes & {"global", "hybrid", "mix"}:
        parts.append(global_candidates(t, hits).withColumn("_m", F.lit(1)))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rows = t.records.select(*_COLUMNS).join(found.withColumnRenamed("id", "_id"), "_id")
    limit = _of(requests, "chunk_top_k", F.col("query"))
    place = Window.partitionBy("query", "_m").orderBy(F.desc("score"), "_id")
    rows = rows.withColumn("_p", F.row_number().over(place)).where(F.col("_p") <= limit)
    if modes & {"hybrid", "mix"}:
        rows = first_wins(rows, ["query", "_id"], [F.col("_m"), F.col("_p")])
        rows = rows.withColumn("_p", F.row_number().over(Window.partitionBy("query").orderBy("_m", "_p"))).where(F.col("_p") <= limit)
    rows = rows.drop("_m", "_p")
    if "mix" in modes and scorer is not None:
        again = rerank(rows.where(mode == "mix"), lambda text: scorer(text, F.col("query")), least, limit)
        rows = rows.where(mode != "mix").unionByName(again)
    return rows


def overlap_scorer(*queries: str) -> Callable[[Column, Column], Column]:
    """A lexical stand-in for a reranking model: share of the query's words found in a text."""
    texts = [" ".join(sorted(set(q.lower().split()))) for q in queries] or [""]

    def score(text: Column, query: Column) -> Column:
        words = F.split(F.element_at(F.array(*map(F.lit, texts)), query + 1), " ")
        return F.size(F.array_intersect(words, F.split(F.lower(text), r"\s+"))) / F.greatest(F.size(words), F.lit(1))

    return score


def rerank(rows: DataFrame, scorer: Callable[[Column], Column] | None, least: float | None = None, k: int | Column | None = None) -> DataFrame:
    """Rows of each query by another score of title and snippet; a missing one leaves the old (F6, C8). Without a scorer: by place."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "_id")
    if scorer is None:
        rows = rows.withColumn("score", 1 - 0.01 * (F.row_number().over(w) - 1))
    else:
        rows = rows.withColumn("score", F.coalesce(scorer(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), snippet(F.coalesce("content", F.lit(""))))), F.col("score")))
    if least is not None:
        rows = rows.where(F.col("score") >= least)
    if k is not None:
        rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
    return rows


def retrieve(t: Tables, r: Request, scorer: Callable[[Column, Column], Column] | None = None, least: float | None = None) -> DataFrame:
    """Answer a request: one row a document, best first."""
    return answer(t, [r], scorer, least).select("source", "record_type", "_id", "content", "score").orderBy(F.desc("score"), "_id")


def edge_weight(confidence: Column) -> Column:
    """Weight shown for a relationship."""
    return half_up(confidence * 10)


#: Words that are no keywords; fixed values.
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for"]


def keywords(text: Column, names: Callable[[Column], Column] | None = None) -> Column:
    """Specific and thematic keywords of a query (H12, F12, G4): a struct of low_level (7 at most) and high_level (5 at most).

    Both are lower-cased, over two letters, without stop words, each once. Names are what ``names`` finds in the text;
    without a tagger, runs of capitalised words are. Other words over three letters are themes, unless a name has them.
    """
    clean = lambda ws: F.array_distinct(F.filter(F.transform(ws, lambda w: F.trim(F.lower(w))), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS)))
    words = F.transform(F.split(text, r"\s+"), lambda w: F.trim(w, F.lit(".,;:!?\"'()")))

    def levels(ws: Column) -> Column:
        low = names(text) if names else F.regexp_extract_all(F.concat(F.lit(" "), F.array_join(ws, " ")), F.lit(r" (\p{Lu}[^ ]*(?: \p{Lu}[^ ]*)*)"), F.lit(1))
        return F.struct(clean(low).alias("low"), clean(F.filter(ws, lambda w: F.length(w) > 3)).alias("rest"))

    def apart(s: Column) -> Column:
        used = F.array_union(s["low"], F.flatten(F.transform(s["low"], lambda p: F.split(p, " "))))
        return F.struct(F.slice(s["low"], 1, 7).alias("low_level"), F.slice(F.array_except(s["rest"], used), 1, 5).alias("high_level"))

    return let(let(words, levels), apart)
