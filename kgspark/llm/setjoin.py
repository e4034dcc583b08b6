"""Jaccard join of documents' shingle sets by partition of the universe and the pigeonhole principle.

Two sets of sizes n <= m that are similar enough differ in at most ``most_apart(m)`` elements. Elements are dealt to k
segments by their hash, so that no set differs from the other in all of them: with numbers v of 0, 1 or 2 whose sum
exceeds that bound, some segment has fewer than v differing elements. v = 1 looks for equal segments, v = 2 also for
segments that become equal when one element is deleted on either side, v = 0 leaves a segment out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm import _blocks
from kgspark.llm._blocks import FAN_BITS, down, in_blocks, pack_bits, prefix, split, unpack_bits, up
from kgspark.llm._links import DIGEST, components, digests, equal_sets, labelled, own_links, shingle_sets, sizes_allow, texts_of
from kgspark.llm._shared import materialize, small_batches
from kgspark.llm._text import U, draw_key, mix, pieces

#: Similarity of linked documents, in hundredths.
PERCENT = 80
#: Segments that each set may leave out beyond those that hold none of its elements.
FREE = 1
#: Bits of a key that travel below its bucket's; a false hit only makes a candidate.
REST = 32
#: Texts of a block.
BLOCK_BYTES = 4 << 20
_ASK = "kind int, bucket long, block long, keys binary, high binary, docs binary, blocks binary, counts binary"
_ASK_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), *((n, pa.binary()) for n in ("keys", "high", "docs", "blocks", "counts"))])
_ANSWER = "kind int, bucket long, block long, shared binary, counts binary, docs binary, blocks binary"
_ANSWER_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), *((n, pa.binary()) for n in ("shared", "counts", "docs", "blocks"))])
#: In a count: some set looks for the key; sets that have it, up to MANY.
SOUGHT, MANY = 128, 127
_ROWS = "key long, id long, size long, bytes long, sought boolean, at long, place long, own long, own_place long"
_ROWS_ARROW = pa.schema([(n, pa.bool_() if n == "sought" else pa.int64()) for n in ("key", "id", "size", "bytes", "sought", "at", "place", "own", "own_place")])
_EQUAL, _LESS = U(0x2545F4914F6CDD1D), U(0x9FB21C651E98DF25)


def most_apart(size: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of two linked sets, the larger of which has ``size`` elements."""
    return 2 * size * (100 - percent) // (100 + percent)


class Schemes:
    """Bands of sizes, and the scheme of segments that each two neighbouring bands share.

    A band begins at 100/percent of the one before, so a linked pair lies in one band or in two neighbouring ones,
    and both sets have keys in the scheme of the larger one's band.
    """

    def __init__(self, percent: int):
        self.percent = percent
        bound = [1]
        while bound[-1] < 1 << 40:
            bound.append(max(bound[-1] + 1, -(-bound[-1] * 100 // percent)))
        self.bound = np.array(bound + [bound[-1] * 2], np.int64)
        top = most_apart(self.bound[2::2] - 1, percent)
        #: Beside one more than the largest difference, some segments for those that stay empty. Where only equal sets can be linked there are none.
        self.segments = np.where(top > 0, top + 2 + top // 24, 0)

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scheme of a set, and the next band's if that is another one (else -1)."""
        band = np.searchsorted(self.bound, sizes, "right") - 1
        own, nearby = band // 2, (band + 1) // 2
        return own, np.where(own == nearby, -1, nearby)


class Segments:
    """The non-empty segments of many sets under one scheme each (none where it is negative)."""

    def __init__(self, sets: list[np.ndarray], scheme: np.ndarray, schemes: Schemes):
        self.k = np.where(scheme >= 0, schemes.segments[np.maximum(scheme, 0)], 0)
        self.scheme = scheme
        use = np.flatnonzero(self.k > 0)
        size = np.array([len(sets[i]) for i in use], np.int64)
        h = np.concatenate([np.zeros(0, U), *(sets[i] for i in use)])
        doc = np.repeat(use, size)
        # Sets are sorted, so the elements of a segment, told by the upper half of the hash, stand together.
        segment = ((h >> U(32)) * self.k[doc].astype(U) >> U(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (segment[1:] != segment[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
        self.value = mix(h ^ _EQUAL)
        self.n = np.diff(np.append(first, len(h)))
        self.sum = np.add.reduceat(self.value, first) if len(h) else np.zeros(0, U)
        self.doc, self.segment = doc[first], segment[first]
        self.run = np.repeat(np.arange(len(first)), self.n)
        self.filled = np.bincount(self.doc, minlength=len(sets))

    def _key(self, what: np.ndarray, run: np.ndarray, salt: U) -> np.ndarray:
        return mix(what ^ mix((self.scheme[self.doc[run]].astype(U) << U(40) | self.segment[run].astype(U)) ^ salt))

    def equal(self, run: np.ndarray) -> np.ndarray:
        """Keys of whole segments."""
        return self._key(self.sum[run], run, _EQUAL)

    def whole_in_deletions(self, run: np.ndarray) -> np.ndarray:
        """Keys of whole segments among those of which an element was deleted."""
        return self._key(self.sum[run], run, _LESS)

    def deletions(self, runs: np.ndarray, salt: U) -> tuple[np.ndarray, np.ndarray]:
        """For each element of the flagged runs the key of its segment without it, and the run."""
        at = np.flatnonzero(runs[self.run])
        run = self.run[at]
        return self._key(self.sum[run] - self.value[at], run, salt), run

    def empty(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the empty segments of the flagged sets, and the sets."""
        keys, owner = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for d in np.flatnonzero(docs & (self.k > 0)).tolist():
            none = np.setdiff1d(np.arange(self.k[d]), self.segment[self.doc == d]).astype(U)
            keys.append(mix(mix((U(int(self.scheme[d])) << U(40) | none) ^ _EQUAL)))
            owner.append(np.full(len(none), d))
        return np.concatenate(keys), np.concatenate(owner)


class Allocation:
    """v of each segment of a set's own scheme, before its costs are known: which are raised to 2, how many may be left out."""

    def __init__(self, seg: Segments, sizes: np.ndarray, percent: int):
        need = most_apart(sizes, percent) + 1
        empty = seg.k - seg.filled
        slack = seg.k - need
        wanted = np.where(seg.k > 0, np.maximum(0, empty + FREE - slack), 0)
        fit = seg.n >= 2
        rank = np.cumsum(fit)
        before = np.concatenate([[0], rank])[np.searchsorted(seg.doc, np.arange(len(sizes)))]
        rank -= before[seg.doc]
        #: The first segments of two elements or more are raised, as many as the set needs; so few have to be indexed by deletions.
        self.raised = fit & (rank <= wanted[seg.doc])
        #: Segments with v = 1 that may be left out; below 0 the set has too few segments, and empty ones count as segments too.
        self.free = np.where(seg.k > 0, slack + np.bincount(seg.doc[self.raised], minlength=len(sizes)) - empty, 0)
        #: Highest raised segment, from 1.
        self.reach = np.zeros(len(sizes), np.int64)
        np.maximum.at(self.reach, seg.doc[self.raised], seg.segment[self.raised] + 1)


def _sketches(percent: int, key: int):
    """Size and digest of each text's set, its scheme, how far its segments are raised, and whether its empty segments count."""
    schemes = Schemes(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in pieces(batch.column(1)):
                sets = shingle_sets(data, offsets, key)
                sizes = np.array([len(s) for s in sets], np.int64)
                own, _ = schemes.of(np.maximum(sizes, 1))
                given = Allocation(Segments(sets, own, schemes), sizes, percent)
                yield pa.record_batch(
                    [batch.column(0).slice(first, last - first), pa.array(sizes), *digests(sets), pa.array(own, pa.int32()), pa.array(given.reach), pa.array(given.free < 0)],
                    ["doc_id", "n_shingles", "digest", "digest2", "scheme", "reach", "short"],
                )

    return run


class _Block:
    """The keys of the sets of a block: index keys of both schemes, and those that a set looks for."""

    def __init__(self, table: pa.Table, percent: int, key: int, schemes: Schemes, reach: dict):
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        table = table.take(pa.array(order))
        self.ids = ids[order]
        sets, lengths = [], [np.zeros(0, np.int64)]
        for _, _, data, offsets in pieces(table.column("text")):
            sets += shingle_sets(data, offsets, key)
            lengths.append(np.diff(offsets) if offsets is not None else np.zeros(0, np.int64))
        self.bytes = np.concatenate(lengths)
        self.sizes = sizes = np.array([len(s) for s in sets], np.int64)
        own, nearby = schemes.of(np.maximum(sizes, 1))
        parts = []  # keys, places in ids, sought, run of the own scheme with v = 1 (or -1)

        def put(keys: np.ndarray, docs: np.ndarray, sought: np.ndarray | bool, run: np.ndarray | None = None) -> None:
            parts.append((keys, docs, np.broadcast_to(sought, keys.shape), np.full(len(keys), -1) if run is None else run))

        for scheme in (own, nearby):
            seg = Segments(sets, scheme, schemes)
            far = np.array([reach.get(int(x), (0, False)) for x in scheme], np.int64).reshape(-1, 2)
            runs = np.arange(len(seg.n))
            indexed = (seg.segment < far[seg.doc, 0]) & (seg.n >= 3)
            keys, at = seg.deletions(indexed, _LESS)
            put(keys, seg.doc[at], False)
            keys, docs = seg.empty(far[:, 1] > 0)
            if scheme is nearby:
                put(seg.equal(runs), seg.doc, False)
                put(keys, docs, False)
                continue
            given = Allocation(seg, sizes, percent)
            put(keys, docs, given.free[docs] < 0)
            put(seg.equal(runs), seg.doc, True, np.where(given.raised, -1, runs))
            put(seg.whole_in_deletions(runs[given.raised]), seg.doc[given.raised], True)
            keys, at = seg.deletions(given.raised, _EQUAL)
            put(keys, seg.doc[at], True)
            self.free = given.free
        self.keys, self.docs, self.sought, self.run = (np.concatenate(x) for x in zip(*parts, strict=True))

    def messages(self, levels: int, block: int) -> list[dict]:
        """Sorted distinct keys, each with its first set, count and mark, to each bucket of the first level."""
        key = self._short(levels)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        if not len(first):
            return []
        docs = np.minimum.reduceat(self.docs[order], first)
        apart = docs != np.maximum.reduceat(self.docs[order], first)
        n = np.where(apart, np.minimum(np.diff(np.append(first, len(key))), MANY), 1)
        n |= np.where(np.logical_or.reduceat(self.sought[order], first), SOUGHT, 0)
        return _messages(key[first], docs, np.full(len(first), block), n, 1, levels, block)

    def _short(self, levels: int) -> np.ndarray:
        return self.keys >> U(64 - FAN_BITS * levels - REST)

    def shared(self, levels: int, answers: dict) -> pa.Table:
        """The keys that several sets have, as rows: key, id, sought, and the first set that has it (its block and place there)."""
        key = self._short(levels)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        cost, docs, blocks = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        for b, i, j in split((key[first] >> U(FAN_BITS * (levels - 1) + REST)).astype(np.int64)):
            _read(answers[b], cost[i:j], docs[i:j], blocks[i:j])
        at = np.repeat(np.arange(len(first)), size)
        # The dearest segments with v = 1 are left out, as many as each set may.
        sought = self.sought[order].copy()
        mine = np.flatnonzero((self.run[order] >= 0) & (cost[at] > 0))
        mine = mine[np.lexsort((-cost[at[mine]], self.docs[order][mine]))]
        owner = self.docs[order][mine]
        rank = np.arange(len(mine)) - np.searchsorted(owner, owner)
        sought[mine[rank < self.free[owner]]] = False
        keep = np.flatnonzero(cost[at] > 0)
        own = self.docs[order][keep]
        return pa.table({"key": self.keys[order][keep].view(np.int64), "id": self.ids[own], "size": self.sizes[own], "bytes": self.bytes[own], "sought": sought[keep], "at": blocks[at[keep]], "place": docs[at[keep]]})


def _messages(key: np.ndarray, docs: np.ndarray, blocks: np.ndarray, n: np.ndarray, level: int, levels: int, block: int) -> list[dict]:
    left = FAN_BITS * (levels - level)
    rest = key & U((1 << (left + REST)) - 1)
    low, high, docs, n = (rest & U(0xFFFFFFFF)).astype("<u4"), (rest >> U(32)).astype("<u4"), docs.astype("<u4"), n.astype(np.uint8)
    return [
        {
            "kind": 0, "bucket": b, "block": block, "keys": low[i:j].tobytes(), "high": high[i:j].tobytes() if left else None, "docs": docs[i:j].tobytes(),
            "blocks": blocks[i:j].astype("<i8").tobytes() if level > 1 else None, "counts": n[i:j].tobytes(),
        }
        for b, i, j in split((key >> U(left + REST)).astype(np.int64))
    ]


def _read(answer: dict, cost: np.ndarray, docs: np.ndarray, blocks: np.ndarray) -> None:
    at = np.flatnonzero(unpack_bits(answer["shared"], len(cost)))
    cost[at] = np.frombuffer(answer["counts"], np.uint8)
    docs[at] = np.frombuffer(answer["docs"], "<u4")
    blocks[at] = np.frombuffer(answer["blocks"], "<i8")


class _Met:
    """Messages of several blocks about one bucket of a level, equal keys together."""

    def __init__(self, table: pa.Table, level: int, levels: int):
        self.rows, self.level, self.levels = table.to_pylist(), level, levels
        keys = [self._keys(r) for r in self.rows]
        self.bounds = np.cumsum([0, *map(len, keys)])
        key = np.concatenate(keys)
        self.order = np.argsort(key, kind="stable")
        key = key[self.order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.size = np.diff(np.append(first, len(key)))
        self.key = key[first]
        docs = np.concatenate([np.frombuffer(r["docs"], "<u4") for r in self.rows]).astype(np.int64)
        blocks = np.concatenate([np.frombuffer(r["blocks"], "<i8") if r["blocks"] is not None else np.full(len(k), r["block"]) for r, k in zip(self.rows, keys, strict=True)])
        # The first set of the smallest block stands for the key.
        low = np.minimum.reduceat(blocks[self.order], first)
        self.blocks = low
        self.docs = np.minimum.reduceat(np.where(blocks[self.order] == np.repeat(low, self.size), docs[self.order], np.iinfo(np.int64).max), first)
        n = np.concatenate([np.frombuffer(r["counts"], np.uint8) for r in self.rows])[self.order].astype(np.int64)
        self.n = np.minimum(np.add.reduceat(n & MANY, first), MANY) | np.bitwise_or.reduceat(n & SOUGHT, first)

    def _keys(self, r: dict) -> np.ndarray:
        key = np.frombuffer(r["keys"], "<u4").astype(U)
        if r["high"] is not None:
            key |= np.frombuffer(r["high"], "<u4").astype(U) << U(32)
        return key | U(r["bucket"]) << U(REST + FAN_BITS * (self.levels - self.level))

    def messages(self, block: int) -> list[dict]:
        """To the next level's buckets."""
        return _messages(self.key, self.docs, self.blocks, self.n, self.level + 1, self.levels, block)

    def replies(self, said: tuple | None) -> pa.Table:
        """To each message: which keys several sets have and one looks for, how many, and the first set."""
        cost, docs, blocks = said or (np.where(self.n > SOUGHT + 1, self.n & MANY, 0), self.docs, self.blocks)
        out = np.empty((3, len(self.order)), np.int64)
        out[:, self.order] = np.repeat(np.stack([cost, docs, blocks]), self.size, axis=1)
        rows = []
        for r, a, b in zip(self.rows, self.bounds[:-1], self.bounds[1:], strict=True):
            has = out[0, a:b] > 0
            rows.append({
                "kind": 0, "bucket": r["bucket"], "block": r["block"], "shared": pack_bits(has), "counts": out[0, a:b][has].astype(np.uint8).tobytes(),
                "docs": out[1, a:b][has].astype("<u4").tobytes(), "blocks": out[2, a:b][has].astype("<i8").tobytes(),
            })
        return pa.Table.from_pylist(rows, schema=_ANSWER_ARROW)


def _asked(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_ASK_ARROW)


def _answers(table: pa.Table) -> dict:
    return {r["bucket"]: r for r in table.to_pylist()}


def _merge(levels: int):
    def at(level: int):
        def run(key, table):
            return _asked(_Met(table, level, levels).messages(key[2].as_py()) if table.num_rows else [])

        return run

    return at


def _unmerge(levels: int):
    def at(level: int):
        def run(key, asked, answers):
            if not asked.num_rows:
                return pa.Table.from_pylist([], schema=_ANSWER_ARROW)
            met, replies = _Met(asked, level, levels), _answers(answers)
            said = tuple(np.zeros(len(met.key), np.int64) for _ in range(3))
            for b, i, j in split((met.key >> U(REST + FAN_BITS * (levels - level - 1))).astype(np.int64)):
                _read(replies[b], *(x[i:j] for x in said))
            return met.replies(said)

        return run

    return at


def jaccard_join(docs: DataFrame, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES, bucket_keys: int = _blocks.BUCKET_KEYS) -> DataFrame:
    """Link documents whose sets of five-word shingles have similarity ``percent`` / 100 or more, and label components.

    ``docs``: doc_id, text; other columns are ignored, so none can clash. Returns doc_id, n_shingles, component_id (the
    smallest doc_id reachable over links, itself included) for each row. Words are split at ASCII white space after
    A-Z are lower-cased. A text with fewer than five words is one shingle; a null or empty text has an empty set and is
    linked with nothing. Repeated rows of one doc_id give one row each and share a component when any of them links; a
    null doc_id has a null component. An empty table gives no rows; equal similarities need no order, since every link
    counts. No link is lost, whatever the hashes: they only choose candidates.

    Equal sets are merged first. Each set has index keys in the scheme of its band of sizes and in the next band's:
    one for each non-empty segment, and in the first segments, as far as any set needs them, one for each element
    deleted. It looks for its own segments (v = 1), for the raised ones also with one element fewer on either side
    (v = 2), and leaves out (v = 0) empty segments and then the dearest, by how many sets have the key, as long as the
    sum exceeds the largest difference. Keys travel packed between blocks of documents and buckets, as counts and the
    first set that has a key; only keys that several sets have and one looks for become rows. Then each set is compared with
    the first one of its keys, and further ones only across components (see :func:`_links.components`).
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    key, schemes = draw_key(), Schemes(percent)
    sketch = materialize(docs.mapInArrow(_sketches(percent, key), "doc_id long, n_shingles long, digest long, digest2 long, scheme int, reach long, short boolean"))
    # A row for each scheme, about one for each doubling of the longest text's size and a half.
    reach = {r["scheme"]: (r["reach"], int(r["short"])) for r in sketch.groupBy("scheme").agg(F.max("reach").alias("reach"), F.max("short").alias("short")).collect()}
    member, reps = equal_sets(sketch)
    least = int(np.flatnonzero(schemes.segments)[0])
    able = reps.where(F.col("n_shingles") >= int(schemes.bound[max(0, 2 * least - 1)])).select("id", *DIGEST)
    texts = texts_of(docs, able.select("id"))
    blocks, levels = in_blocks(texts.select(F.col("id").alias("doc_id"), "text"), block_bytes, bucket_keys)
    blocks = blocks.withColumnRenamed("doc_id", "id").groupBy("block")

    def ask(of, table):
        return _asked(_Block(table, percent, key, schemes, reach).messages(levels, of[0].as_py()))

    def answer(of, table):
        return _Met(table, levels, levels).replies(None)

    def rows(of, table, answers):
        if not table.num_rows:
            return pa.Table.from_pylist([], schema=_ROWS_ARROW)
        block = _Block(table, percent, key, schemes, reach)
        out = block.shared(levels, _answers(answers))
        place = np.searchsorted(block.ids, out.column("id").to_numpy())
        return out.append_column("own", pa.array(np.full(len(place), of[0].as_py()))).append_column("own_place", pa.array(place))

    frames = up(blocks.applyInArrow(ask, _ASK), levels, _merge(levels), _ASK)
    replies = down(frames, frames[-1].groupBy("kind", "bucket").applyInArrow(answer, _ANSWER), _unmerge(levels), _ANSWER)
    found = materialize(blocks.cogroup(replies.groupBy("block")).applyInArrow(rows, _ROWS))
    sizes = materialize(found.groupBy("key").agg(F.count("*").alias("n"), F.max("sought").alias("sought")).where("n > 1 and sought").select("key", "n"))
    bucket = materialize(found.drop("sought").join(sizes, "key"))
    near = materialize(texts.join(bucket.select("id").distinct(), "id", "left_semi"))
    names = bucket.groupBy(F.col("own").alias("at"), F.col("own_place").alias("place")).agg(F.min(F.struct("id", "size")).alias("hub"))
    first = bucket.where("at <> own or place <> own_place").select("id", "size", "at", "place").distinct().join(names, ["at", "place"])
    first = first.where((F.col("hub.id") != F.col("id")) & sizes_allow(F.col("hub.size"), F.col("size"), percent)).groupBy(F.col("id").alias("b")).agg(F.min("hub.id").alias("a"))
    comp = components(first, bucket.select("key", "id", "n", "size", "bytes"), own_links(member), near, percent)
    return labelled(sketch, member, comp)


def op13_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


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
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(src, dst) AS (SELECT a, b FROM both_ways UNION SELECT r.src, e.b FROM reach r JOIN both_ways e ON e.a = r.dst),
low AS (SELECT src, min(dst) AS m FROM reach GROUP BY src)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM lowered d LEFT JOIN sizes s USING (doc_id) LEFT JOIN low ON low.src = d.doc_id
"""
