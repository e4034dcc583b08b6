"""Removal of repeated passages by fixed-block anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm import _blocks
from kgspark.llm._blocks import FAN_BITS, down, groups, in_blocks, pack_bits, prefix, split, unpack_bits, up
from kgspark.llm._shared import small_batches
from kgspark.llm._text import SPACES, U, Words, draw_key, pieces, run_hashes, text_buffers

WINDOW = 50
ANCHORS, WINDOWS = 1, 2
#: An anchor's message has so many bits of its hash beside its bucket's; a false hit only makes a candidate.
REST = 32
_ASK = "bucket long, block long, kind int, keys binary, high binary, docs binary, many binary, anchor binary"
_ASK_ARROW = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), *((n, pa.binary()) for n in ("keys", "high", "docs", "many", "anchor"))])
_ANSWER = "bucket long, block long, kind int, bits binary"
_ANSWER_ARROW = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("bits", pa.binary())])
_LAST = np.iinfo(np.int64).max


def _anchor_messages(block: int, key: np.ndarray, many: np.ndarray, anchor: np.ndarray, level: int, levels: int) -> list[dict]:
    """Sorted anchor keys (FAN_BITS a level and REST bits) as a message to each bucket of a level."""
    left = FAN_BITS * (levels - level)
    rest = key & U((1 << (left + REST)) - 1)
    return [
        {
            "bucket": b, "block": block, "kind": ANCHORS, "keys": (rest[i:j] & U(0xFFFFFFFF)).astype("<u4").tobytes(), "high": (rest[i:j] >> U(32)).astype("<u4").tobytes() if left else None,
            "docs": None, "many": pack_bits(many[i:j]), "anchor": pack_bits(anchor[i:j]),
        }
        for b, i, j in split((key >> U(left + REST)).astype(np.int64))
    ]


def _window_messages(block: int, key: np.ndarray, low: np.ndarray, level: int) -> list[dict]:
    """Sorted window keys (two hashes each) with their smallest document as a message to each bucket of a level."""
    return [
        {"bucket": b, "block": block, "kind": WINDOWS, "keys": key[i:j].tobytes(), "high": None, "docs": low[i:j].tobytes(), "many": None, "anchor": None}
        for b, i, j in split(prefix(key[:, 0], level))
    ]


class _Met:
    """Messages of several blocks about one bucket of a level, equal keys together."""

    def __init__(self, table, level: int, levels: int):
        self.rows, self.level, self.levels = table.to_pylist(), level, levels
        self.kind = self.rows[0]["kind"]
        keys = [self._keys(r) for r in self.rows]
        self.bounds = np.cumsum([0, *map(len, keys)])
        key = np.concatenate(keys)
        self.order = np.lexsort(key.T[::-1])
        key = key[self.order]
        first = self.first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        self.size = np.diff(np.append(first, len(key)))
        self.key = key[first]
        if self.kind == ANCHORS:
            many, self.anchor = (np.logical_or.reduceat(np.concatenate([unpack_bits(r[c], len(k)) for r, k in zip(self.rows, keys, strict=True)])[self.order], first) for c in ("many", "anchor"))
            self.many = many | (self.size > 1)
        else:
            self.docs = np.concatenate([np.frombuffer(r["docs"], np.int64) for r in self.rows])[self.order]
            self.low = np.minimum.reduceat(self.docs, first)

    def _keys(self, r: dict) -> np.ndarray:
        if self.kind == WINDOWS:
            return np.frombuffer(r["keys"], "<u8").reshape(-1, 2)
        key = np.frombuffer(r["keys"], "<u4").astype(U)
        if r["high"] is not None:
            key |= np.frombuffer(r["high"], "<u4").astype(U) << U(32)
        return key[:, None] | U(r["bucket"]) << U(REST + FAN_BITS * (self.levels - self.level))

    def messages(self, block: int) -> list[dict]:
        """To the next level's buckets."""
        if self.kind == ANCHORS:
            return _anchor_messages(block, self.key[:, 0], self.many, self.anchor, self.level + 1, self.levels)
        return _window_messages(block, self.key, self.low, self.level + 1)

    def replies(self, said: np.ndarray | None) -> pa.Table:
        """To each message: is the anchor a block of some document and found in two? Or does a smaller document have the window?"""
        if self.kind == ANCHORS:
            found = np.repeat(self.many & self.anchor if said is None else said, self.size)
        else:
            found = self.docs > np.repeat(self.low, self.size)
            if said is not None:
                found |= np.repeat(said, self.size)
        bits = np.empty(len(found), bool)
        bits[self.order] = found
        rows = [{"bucket": r["bucket"], "block": r["block"], "kind": self.kind, "bits": pack_bits(bits[a:b])} for r, a, b in zip(self.rows, self.bounds[:-1], self.bounds[1:], strict=True)]
        return pa.Table.from_pylist(rows, schema=_ANSWER_ARROW)


class _Block:
    """Words, anchors and windows of the documents of one block."""

    def __init__(self, table: pa.Table, window: int, levels: int, keys: tuple[int, int]):
        self.table, self.window, self.levels, self.keys = table, window, levels, keys
        self.ids = table.column("doc_id").combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        size = window // 2
        self.words, counts = self._words(keys[0])
        self.count = np.concatenate([np.zeros(0, np.int64), *counts])
        self.owner = np.repeat(np.arange(len(self.count), dtype=np.int32), self.count)
        self.start = np.concatenate([[0], np.cumsum(self.count)])
        place = np.arange(len(self.words)) - self.start[self.owner]
        left = self.count[self.owner] - place
        self.whole = left >= window
        self.anchors = np.zeros(len(self.words), U)
        (r,) = run_hashes(self.words, size)
        self.anchors[: len(r)] = np.maximum(r, U(1) << U(63 - FAN_BITS * levels - REST))
        self.anchors[left < size] = 0
        self.aligned = (place % size == 0) & (left >= size)

    def _words(self, key: int) -> tuple[np.ndarray, list]:
        hashes, counts = [np.zeros(0, U)], []
        for _, _, data, offsets in pieces(self.table.column("text")):
            w = Words(data, offsets, SPACES, False, key)
            hashes.append(w.hash)
            counts.append(np.diff(w.first))
        return np.concatenate(hashes), counts

    def anchor_keys(self) -> tuple:
        """Places of the anchors in order of their keys, and the first of each key."""
        at = np.flatnonzero(self.anchors)
        key = self.anchors[at] >> U(64 - FAN_BITS * self.levels - REST)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        return at, key, groups(key)

    def ask_anchors(self, block: int) -> list[dict]:
        at, key, first = self.anchor_keys()
        if not len(first):
            return []
        docs = self.ids[self.owner[at]]  # in row order within a key, in which rows of one document may enclose another's
        many = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)
        anchor = np.logical_or.reduceat(self.aligned[at], first)
        return _anchor_messages(block, key[first], many, anchor, 1, self.levels)

    def candidates(self, answers: dict) -> tuple:
        """Windows that hold an anchor found in another document: places by key, first of each key, the keys, each one's smallest document."""
        at, key, first = self.anchor_keys()
        hit = np.zeros(len(first), bool)
        for b, i, j in split((key[first] >> U(FAN_BITS * (self.levels - 1) + REST)).astype(np.int64)):
            hit[i:j] = unpack_bits(answers[ANCHORS, b], j - i)
        n = len(self.words)
        total = np.zeros(n + 1, np.int32)
        total[at[np.repeat(hit, np.diff(np.append(first, len(at))))] + 1] = 1
        np.cumsum(total, out=total)
        reach = self.window - self.window // 2 + 1
        at = np.flatnonzero((total[np.minimum(np.arange(n) + reach, n)] > total[:n]) & self.whole)
        if not len(at):
            return at, at, np.zeros((0, 2), U), at
        key = np.stack([run_hashes(h, self.window)[0][at] for h in (self.words, self._words(self.keys[1])[0])], 1)
        order = np.lexsort(key.T[::-1])
        at, key = at[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        return at, first, key[first], np.minimum.reduceat(self.ids[self.owner[at]], first)

    def ask_windows(self, block: int, answers: dict) -> list[dict]:
        _, _, key, low = self.candidates(answers)
        return _window_messages(block, key, low, 1)

    def remove(self, answers: dict) -> pa.Table:
        at, first, key, low = self.candidates(answers)
        earlier = np.zeros(len(first), bool)
        for b, i, j in split(prefix(key[:, 0], 1)):
            earlier[i:j] = unpack_bits(answers[WINDOWS, b], j - i)
        size = np.diff(np.append(first, len(at)))
        gone = at[np.repeat(earlier, size) | (self.ids[self.owner[at]] > np.repeat(low, size))]
        edge = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + self.window, -1)
        removed = np.cumsum(edge)[:-1] > 0
        total = np.concatenate([[0], np.cumsum(removed)])
        n_removed = total[self.start[1:]] - total[self.start[:-1]]
        data, offsets = text_buffers(self.table.column("text"))
        texts, spans = [], []
        for d, n in enumerate(n_removed.tolist()):
            words = data[offsets[d] : offsets[d + 1]].tobytes().split()
            runs = []
            if n:
                mask = removed[self.start[d] : self.start[d + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).tolist()
                runs = [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
            texts.append(b" ".join(words))
            spans.append(runs)
        return pa.table(
            {
                "doc_id": self.table.column("doc_id"),
                "n_words": pa.array(self.count, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }
        )


def _asked(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_ASK_ARROW)


def _answers(table: pa.Table) -> dict:
    return {(r["kind"], r["bucket"]): r["bits"] for r in table.to_pylist()}


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
            said = np.zeros(len(met.first), bool)
            buckets = (met.key[:, 0] >> U(REST + FAN_BITS * (levels - level - 1))).astype(np.int64) if met.kind == ANCHORS else prefix(met.key[:, 0], level + 1)
            for b, i, j in split(buckets):
                said[i:j] = unpack_bits(replies[met.kind, b], j - i)
            return met.replies(said)

        return run

    return at


def remove_repeats(docs: DataFrame, window: int = WINDOW, block_bytes: int = _blocks.BLOCK_BYTES, bucket_keys: int = _blocks.BUCKET_KEYS) -> DataFrame:
    """Remove the words covered by a run of ``window`` words that also starts in a document with a smaller doc_id.

    ``docs``: doc_id, text; other columns are ignored. Returns doc_id, n_words, n_removed, kept_text (kept words
    joined by one space) and spans (the removed maximal repeats, in words, end exclusive) for each row. Words are
    split at ASCII white space and compared unchanged. Null and empty texts have no words. Rows with equal doc_id do
    not remove each other's words; a null doc_id counts as larger than any other. A text longer than a block is a
    block of its own. Equal rows lie in one block.

    Any run of ``window`` words holds a block of window//2 words that starts at a multiple of that size in the
    document it is taken from. Those blocks are the index; every rolling block probes it. Hits found in two
    documents are extended to the windows around them; equal windows meet, the smallest document keeps its copy,
    and overlapping removed windows join to maximal repeats. Windows count as equal when two hashes of 64 bits under
    keys drawn for the run are. Texts are shuffled once; the index, probes and windows travel as packed hashes, in
    messages whose number grows in proportion to the texts.
    """
    small_batches(docs.sparkSession)
    docs, levels = in_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), block_bytes, bucket_keys)
    keys = (draw_key(), draw_key())

    def ask_anchors(key, table):
        return _asked(_Block(table, window, levels, keys).ask_anchors(key[0].as_py()))

    def ask_windows(key, table, answers):
        return _asked(_Block(table, window, levels, keys).ask_windows(key[0].as_py(), _answers(answers)) if table.num_rows else [])

    def remove(key, table, answers):
        return _Block(table, window, levels, keys).remove(_answers(answers))

    def answer(key, table):
        return _Met(table, levels, levels).replies(None)

    def resolve(asks: DataFrame) -> DataFrame:
        frames = up(asks, levels, _merge(levels), _ASK)
        return down(frames, frames[-1].groupBy("kind", "bucket").applyInArrow(answer, _ANSWER), _unmerge(levels), _ANSWER)

    blocks = docs.groupBy("block")
    one = resolve(blocks.applyInArrow(ask_anchors, _ASK))
    two = resolve(blocks.cogroup(one.groupBy("block")).applyInArrow(ask_windows, _ASK))
    return blocks.cogroup(one.union(two).groupBy("block")).applyInArrow(
        remove, "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:long,end:long>>"
    )


def op8_anchor_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)),
lows AS (SELECT h, min(doc_id) AS low FROM windows GROUP BY h),
gone AS (SELECT doc_id, i FROM windows JOIN lows USING (h) WHERE doc_id > low),
covered AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM gone) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(p), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN p IS NULL THEN array_to_string(w, ' ') ELSE array_to_string([w[k] for k in range(1, len(w) + 1) if NOT list_contains(p, k)], ' ') END) AS kept_sha256
FROM docs d LEFT JOIN covered c USING (doc_id)
"""
