"""Language-model scores by context-tree weighting over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm import _blocks
from kgspark.llm._blocks import down, groups, in_blocks, measured, prefix, split, up
from kgspark.llm._shared import materialize, small_batches
from kgspark.llm._text import SPACES, U, Words, draw_key, mix, text_buffers

#: Bytes of context. A byte and its context fit 48 bits: the most recent byte first, then older ones, then the byte.
DEPTH = 5
#: Depth from which on trees are built in buckets. A bucket holds whole contexts of this depth, below each of which
#: there are at most 2**24 grams; sums for the depths above are aggregated.
TOP = 3
#: Texts of a block, and of one step within it.
BLOCK_BYTES, PIECE = 16 << 20, 1 << 20
GRAMS, TOKENS = 0, 1
#: The end of a text among the hashed tokens, and its byte (no word holds white space).
END = U(0x0E0D0E0D0E0D0E0D)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ASK = "kind int, bucket long, block long, keys binary, counts binary"
_ASK_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_REPLY = "kind int, bucket long, block long, values binary"
_REPLY_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("values", pa.binary())])
_MODEL = "kind int, bucket long, keys binary, counts binary, distinct long, total long"


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0 (Stirling's series, shifted by eight for small x)."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    small = x < 8
    low = x[small]
    shift[small] = sum(np.log(low + k) for k in range(8)) if len(low) else 0
    y = np.where(small, x + 8, x)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


#: Logarithms of gamma at k + 1/2 and k + 1; most counts are small.
_SMALL = 1 << 16
_HALF, _WHOLE = log_gamma(np.arange(_SMALL) + 0.5), log_gamma(np.arange(_SMALL) + 1.0)


def _looked_up(n: np.ndarray, table: np.ndarray, offset: float) -> np.ndarray:
    n = n.astype(np.int64)
    out = table[np.minimum(n, _SMALL - 1)]
    large = n >= _SMALL
    if large.any():
        out[large] = log_gamma(n[large] + offset)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _looked_up(n0, _HALF, 0.5) + _looked_up(n1, _HALF, 0.5) - 2 * 0.5723649429247001 - _looked_up(n0 + n1, _WHOLE, 1.0)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate([np.zeros(0, U), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = groups(key)
    return key[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def streams(column: pa.Array, token_key: int) -> Iterator[tuple]:
    """Grams and token hashes (under a key) of some texts at a time, with the number of either in each text.

    Texts are lower-cased, their words joined by one space and closed by an end.
    """
    data, offsets = text_buffers(column)
    raw, n = data.tobytes(), len(offsets) - 1
    first = 0
    pad = b"\n" * DEPTH
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
        texts = [b" ".join(raw[offsets[i] : offsets[i + 1]].translate(_LOWER).split()) + b"\n" for i in range(first, last)]
        size = np.array([len(t) for t in texts])
        b = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8)
        ends = np.cumsum(size + DEPTH)
        code = b.astype(U)
        for k in range(1, DEPTH + 1):
            code[k:] |= b[:-k].astype(U) << U(8 * (DEPTH + 1 - k))
        real = np.ones(len(b), bool)
        for k in range(DEPTH):
            real[ends - size - 1 - k] = False
        w = Words(b, np.concatenate([[0], ends]), SPACES, False, token_key)
        yield code[real], np.insert(w.hash, w.first[1:], END), size, np.diff(w.first) + 1
        first = last


def distinct(column: pa.Array, token_key: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct grams and distinct tokens of some texts, sorted, with their counts."""
    found: list[list] = [[], []]
    for part in streams(column, token_key):
        for kind in (GRAMS, TOKENS):
            key = np.sort(part[kind])
            first = groups(key)
            found[kind].append((key[first], np.diff(np.append(first, len(key)))))
    return [_merge([k for k, _ in f], [n for _, n in f]) for f in found]


def sums(column: pa.Array, token_key: int, keys: list[np.ndarray], values: list[list[np.ndarray]]) -> tuple[list, list[list]]:
    """Number of grams and tokens of each text, and the sums over them of some values of their keys."""
    sizes: list = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    out: list = [[[np.zeros(0)] for _ in v] for v in values]
    for part in streams(column, token_key):
        for kind in (GRAMS, TOKENS):
            key, inverse = np.unique(part[kind], return_inverse=True)
            at = np.searchsorted(keys[kind], key)
            n = part[2 + kind]
            sizes[kind].append(n)
            for v, o in zip(values[kind], out[kind], strict=True):
                o.append(np.add.reduceat(v[at][inverse], np.concatenate([[0], np.cumsum(n)[:-1]])))
    return [np.concatenate(x) for x in sizes], [[np.concatenate(o) for o in x] for x in out]


def spread(kind: int, keys: np.ndarray) -> np.ndarray:
    """What names the buckets of keys: a hash of the three newest bytes of a gram's context; a token is a hash itself."""
    return mix((keys >> U(8 * (DEPTH + 1 - TOP))) + U(1)) if kind == GRAMS else keys


def messages(kind: int, block: int, keys: np.ndarray, counts: np.ndarray | None, level: int) -> list[dict]:
    """Distinct keys, with their counts, as a message to each bucket of a level."""
    h = spread(kind, keys)
    order = np.lexsort((keys, h)) if kind == GRAMS else np.argsort(keys)
    keys, h = keys[order], h[order]
    n = None if counts is None else counts[order]
    width = "<u4" if level == 1 else "<i8"
    return [{"kind": kind, "bucket": b, "block": block, "keys": keys[i:j].tobytes(), "counts": None if n is None else n[i:j].astype(width).tobytes()} for b, i, j in split(prefix(h, level))]


class _Met:
    """Messages of several blocks about one bucket: the distinct keys, sorted, and the sums of their counts."""

    def __init__(self, table):
        self.rows = table.to_pylist()
        self.own = [np.frombuffer(r["keys"], U) for r in self.rows]
        counted = [np.frombuffer(r["counts"], "<u4" if len(r["counts"]) < len(r["keys"]) else "<i8").astype(np.int64) if r["counts"] is not None else np.zeros(len(k), np.int64) for r, k in zip(self.rows, self.own, strict=True)]
        self.key, self.n = _merge(self.own, counted)

    def replies(self, values: np.ndarray) -> pa.Table:
        """The values of its keys to each message."""
        rows = [{"kind": r["kind"], "bucket": r["bucket"], "block": r["block"], "values": values[np.searchsorted(self.key, k)].tobytes()} for r, k in zip(self.rows, self.own, strict=True)]
        return pa.Table.from_pylist(rows, schema=_REPLY_ARROW)


def _merge_level(counted: bool):
    def at(level: int):
        def run(key, table):
            met = _Met(table)
            rows = messages(key[0].as_py(), key[2].as_py(), met.key, met.n if counted else None, level + 1) if met.rows else []
            return pa.Table.from_pylist(rows, schema=_ASK_ARROW)

        return run

    return at


def _value_type(kind: int) -> str:
    return "<f4" if kind == GRAMS else "<i8"


def _unmerge(level: int):
    def run(key, asked, replies):
        if not asked.num_rows:
            return pa.Table.from_pylist([], schema=_REPLY_ARROW)
        kind, met = key[0].as_py(), _Met(asked)
        h = spread(kind, met.key)
        order = np.lexsort((met.key, h)) if kind == GRAMS else np.arange(len(h))
        said = {r["bucket"]: r["values"] for r in replies.to_pylist()}
        values = np.zeros(len(h), _value_type(kind))
        for b, i, j in split(prefix(h[order], level + 1)):
            values[order[i:j]] = np.frombuffer(said[b], _value_type(kind))
        return met.replies(values)

    return run


class Tree:
    """Weighted context trees of one bucket, for depths TOP to DEPTH, one for each of the 255 bit nodes of a byte."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.levels: dict[int, list[dict]] = {}
        below: list | None = None
        for depth in range(DEPTH, TOP - 1, -1):
            if depth < DEPTH:
                codes, counts = _merge([(codes >> U(16) << U(8)) | (codes & U(255))], [counts])
            here = []
            for k in range(8):
                node = codes >> U(8 - k)
                first = groups(node)
                key = node[first]
                ones = counts * ((codes >> U(7 - k)) & U(1)).astype(np.int64)
                n = np.add.reduceat(counts, first) if len(first) else counts[:0]
                n1 = np.add.reduceat(ones, first) if len(first) else counts[:0]
                estimate = log_kt(n - n1, n1)
                weighted = estimate
                if below is not None:
                    child = below[k]
                    # Drop the oldest byte of the context: it lies above the k known bits of the byte.
                    up = (child["key"] >> U(8 + k) << U(k)) | (child["key"] & U((1 << k) - 1))
                    inner = np.bincount(np.searchsorted(key, up), child["weighted"], minlength=len(key))
                    weighted = np.logaddexp(estimate, inner) - np.log(2)
                here.append({"key": key, "n0": n - n1, "n1": n1, "estimate": estimate, "weighted": weighted})
            self.levels[depth] = below = here

    def log10(self, codes: np.ndarray, upper: dict) -> np.ndarray:
        """log10 probability of the byte of each code after its context, mixed over all depths."""
        out = np.zeros(len(codes))
        byte = codes & U(255)
        for k in range(8):
            bit = ((byte >> U(7 - k)) & U(1)).astype(bool)
            known = byte >> U(8 - k)
            p = np.full(len(codes), np.nan)
            for depth in range(DEPTH, -1, -1):
                if depth >= 2:
                    if depth >= TOP:
                        level = self.levels[depth][k]
                        want, values = (codes >> U(8 * (DEPTH + 1 - depth)) << U(k)) | known, (level["n0"], level["n1"], np.exp(level["estimate"] - np.log(2) - level["weighted"]))
                    else:
                        level = upper[2]
                        want, values = (codes >> U(8 * (DEPTH - 1)) << U(8)) | U(1 << k) | known, (level["n0"], level["n1"], level["weight"])
                    at = np.minimum(np.searchsorted(level["key"], want), max(len(level["key"]) - 1, 0))
                    seen = level["key"][at] == want if len(level["key"]) else np.zeros(len(want), bool)
                    n0, n1, weight = (np.zeros(len(want)) for _ in range(3))
                    for x, v in zip((n0, n1, weight), values, strict=True):
                        x[seen] = v[at[seen]]
                else:
                    at = ((codes >> U(8 * DEPTH) if depth else codes * U(0)) << U(8) | (U(1 << k) | known)).astype(np.int64)
                    n0, n1, weight = (upper[depth][x][at] for x in ("n0", "n1", "weight"))
                    seen = n0 + n1 > 0
                estimate = (np.where(bit, n1, n0) + 0.5) / (n0 + n1 + 1)
                # The deepest context that was seen counts as a leaf; above it, estimates are mixed.
                mixed = np.where(np.isnan(p), estimate, weight * estimate + (1 - weight) * np.nan_to_num(p))
                p = np.where(seen, mixed, p)
            out += np.log10(np.where(np.isnan(p), 0.5, p))
        return out


def weighed(n0: np.ndarray, n1: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of a node's weighted probability, and the share of its own estimate in it."""
    estimate = log_kt(n0, n1)
    whole = np.logaddexp(estimate, inner) - np.log(2)
    return whole, np.exp(estimate - np.log(2) - whole)


def parent_sums(tree: Tree) -> tuple[np.ndarray, ...]:
    """Of a tree's nodes of depth TOP: their parents (context, then a one and the known bits of the byte), and sums over each one's children here."""
    level = tree.levels[TOP]
    key = np.concatenate([(x["key"] >> U(k + 8) << U(8)) | U(1 << k) | (x["key"] & U((1 << k) - 1)) for k, x in enumerate(level)])
    node, at = np.unique(key, return_inverse=True)
    return node.astype(np.int64), *(np.bincount(at, np.concatenate([x[c] for x in level]), len(node)).astype(float) for c in ("n0", "n1", "weighted"))


def upper_levels(node: np.ndarray, n0: np.ndarray, n1: np.ndarray, inner: np.ndarray) -> dict:
    """Nodes of depths 0 and 1 as dense tables, from the sums over the children of those of depth 1."""
    out: dict = {}
    for depth in (1, 0):
        size = 1 << (8 + 8 * depth)
        a0, a1, below = (np.bincount(node, x, minlength=size) for x in (n0, n1, inner))
        whole, weight = weighed(a0, a1, below)
        out[depth] = {"n0": a0, "n1": a1, "weight": weight}
        live = np.flatnonzero(a0 + a1)
        node, n0, n1, inner = live & 0xFF, a0[live], a1[live], whole[live]
    return out


def sender_number(partition: int, flush: int, senders: int) -> int:
    """A number below ``senders`` for a task's block. Messages of training need no answer, so blocks may share a number;
    numbers without gaps let those of all tasks meet in groups of FAN on the next level."""
    return int(mix(np.array([partition << 32 | flush], U))[0] % U(senders))


def _count(token_key: int, block_bytes: int, senders: int):
    """Messages with the distinct keys of texts (text, train), about a block's bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        partition, flushes = context.partitionId() if context else 0, 0

        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal flushes
            sender = sender_number(partition, flushes, senders)
            found: list[tuple[list, list]] = [([], []), ([], [])]
            for batch in held:
                train = batch.column(1).fill_null(False)
                for known in (True, False):
                    for kind, (key, n) in enumerate(distinct(batch.column(0).filter(train if known else pc.invert(train)), token_key)):
                        found[kind][0].append(key)
                        found[kind][1].append(n if known else 0 * n)
            rows = [m for kind in (GRAMS, TOKENS) for m in messages(kind, sender, *_merge(*found[kind]), 1)]
            flushes += 1
            yield from pa.Table.from_pylist(rows, schema=_ASK_ARROW).to_batches()

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= block_bytes:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _merged(key, table):
    met = _Met(table)
    return pa.table({"kind": pa.array([key[0].as_py()], pa.int32()), "bucket": [key[1].as_py()], "keys": [met.key.tobytes()], "counts": [met.n.tobytes()], "distinct": [int((met.n > 0).sum())], "total": [int(met.n.sum())]})


def _known(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.frombuffer(keys, U), np.frombuffer(counts, np.int64)
    return key[n > 0], n[n > 0]


_NODES = "node long, n0 double, n1 double, inner double"


def _parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.record_batch([pa.array(x) for x in parent_sums(Tree(*_known(keys, counts)))], ["node", "n0", "n1", "inner"])


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n0, n1, inner = (batch.column(k).to_numpy() for k in (1, 2, 3))
        whole, weight = weighed(n0, n1, inner)
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(whole), pa.array(weight)], ["node", "n0", "n1", "weighted", "weight"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of two bytes that a bucket's grams have."""
    for batch in batches:
        for bucket, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = np.unique(np.frombuffer(keys, U) >> U(8 * (DEPTH - 1))).astype(np.int64)
            yield pa.record_batch([pa.array(np.full(len(found), bucket)), pa.array(found)], ["bucket", "context"])


def _packed_nodes(key, table):
    node, n0, n1, weight = (table.column(c).to_numpy() for c in ("node", "n0", "n1", "weight"))
    order = np.argsort(node)
    return pa.table({"kind": pa.array([GRAMS], pa.int32()), "bucket": [key[0].as_py()], "keys": pa.array([None], pa.binary()), "counts": pa.array([None], pa.binary()), "nodes": [node[order].astype(U).tobytes()], "values": [np.stack([n0[order], n1[order], weight[order]]).tobytes()]})


def fit(rows: DataFrame, levels: int, token_key: int, block_bytes: int, senders: int) -> tuple[DataFrame, dict, int, int]:
    """Models of the texts of ``rows`` (text, train) that are to be learned from.

    Returns what answers need by bucket (counts of all grams and tokens, those of the other texts with count 0, and
    the nodes of depth 2 above them), the nodes of depths 0 and 1, and the number and kinds of tokens.
    """
    asks = up(rows.select("text", "train").mapInArrow(_count(token_key, block_bytes, senders), _ASK), levels, _merge_level(True), _ASK)[-1]
    model = materialize(asks.groupBy("kind", "bucket").applyInArrow(_merged, _MODEL))
    grams = model.where(F.col("kind") == GRAMS)
    nodes = grams.select("keys", "counts").mapInArrow(_parents, _NODES).groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("inner").alias("inner"))
    nodes = materialize(nodes.mapInArrow(_weigh, "node long, n0 double, n1 double, weighted double, weight double"))
    above = F.shiftleft(F.shiftright("node", 16), 8).bitwiseOR(F.col("node").bitwiseAND(255))
    # At most 256 contexts of 255 nodes.
    one = nodes.groupBy(above.alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("inner")).toArrow()
    upper = upper_levels(*(one.column(c).to_numpy() for c in ("node", "n0", "n1", "inner")))
    tokens = model.where(F.col("kind") == TOKENS).agg(F.sum("total"), F.sum("distinct")).first()
    contexts = grams.select("bucket", "keys").mapInArrow(_contexts, "bucket long, context long")
    own = contexts.join(nodes.withColumn("context", F.shiftright("node", 8)), "context").groupBy("bucket").applyInArrow(_packed_nodes, "kind int, bucket long, keys binary, counts binary, nodes binary, values binary")
    known = model.select("kind", "bucket", "keys", "counts", F.lit(None).cast("binary").alias("nodes"), F.lit(None).cast("binary").alias("values")).union(own)
    return known, upper, tokens[0] or 0, tokens[1] or 0


def _answer(shared):
    def run(key, asked, known):
        if not asked.num_rows:
            return pa.Table.from_pylist([], schema=_REPLY_ARROW)
        met, kind = _Met(asked), key[0].as_py()
        own, counts = np.zeros(0, U), np.zeros(0, np.int64)
        nodes, values = np.zeros(0, U), np.zeros((3, 0))
        for r in known.to_pylist():
            if r["keys"] is not None:
                own, counts = _known(r["keys"], r["counts"])
            else:
                nodes = np.frombuffer(r["nodes"], U)
                values = np.frombuffer(r["values"]).reshape(3, -1)
        if kind == GRAMS:
            upper = shared | {2: {"key": nodes, "n0": values[0], "n1": values[1], "weight": values[2]}}
            return met.replies(Tree(own, counts).log10(met.key, upper).astype("<f4"))
        at = np.minimum(np.searchsorted(own, met.key), max(len(own) - 1, 0))
        return met.replies(np.where(own[at] == met.key, counts[at], 0) if len(own) else np.zeros(len(met.key), np.int64))

    return run


def score(docs: DataFrame, trained_on: DataFrame | Column | None = None, block_bytes: int = BLOCK_BYTES, bucket_keys: int = _blocks.BUCKET_KEYS) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) with models of ``trained_on``.

    ``trained_on``: a table with a text column, or a condition on rows of ``docs``; default: all of ``docs``. Other
    columns are ignored, so none can clash. Returns doc_id, n_tokens, n_known, train_tokens, base_score (token
    unigrams), score (log10 probability of the text, words lower-cased and joined by one space, with its end),
    n_bytes and bits_per_byte. A null or empty text is its end alone. Nothing known of a context leaves each bit at
    one half. Rows may repeat; an empty table gives no rows. A text longer than a block is a block of its own.

    Counts of all bytes after up to DEPTH bytes, and of all tokens (by a 64-bit hash under a key drawn for the run),
    are merged in buckets without any limit; only the nodes of depths 0 and 1 (at most 2**16) are collected and sent
    to all. Blocks of documents ask the buckets for their distinct grams and tokens, each once. A gram's probability
    mixes the Krichevsky-Trofimov estimates of all depths on its path by the weights that the training counts give.
    """
    small_batches(docs.sparkSession)
    train = F.lit(True) if trained_on is None else trained_on if isinstance(trained_on, Column) else F.lit(False)
    rows = docs.select("text", train.alias("train"))
    if isinstance(trained_on, DataFrame):
        rows = rows.union(trained_on.select("text", F.lit(True)))
    made = measured(docs, block_bytes, bucket_keys)
    senders = made[0] + (measured(trained_on, block_bytes)[0] if isinstance(trained_on, DataFrame) else 0)
    docs, levels = in_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), made=made)
    token_key = draw_key()
    known, upper, n_tokens, n_kinds = fit(rows, levels, token_key, block_bytes, senders)

    def ask(key, table):
        asked: list[dict] = []
        for kind, (keys, _) in enumerate(distinct(table.column("text"), token_key)):
            asked += messages(kind, key[0].as_py(), keys, None, 1)
        return pa.Table.from_pylist(asked, schema=_ASK_ARROW)

    def finish(key, table, answers):
        replies = {(r["kind"], r["bucket"]): r["values"] for r in answers.to_pylist()}
        found = []
        for kind, (keys, _) in enumerate(distinct(table.column("text"), token_key)):
            h = spread(kind, keys)
            order = np.lexsort((keys, h)) if kind == GRAMS else np.arange(len(keys))
            values = np.zeros(len(keys))
            for i, x, y in split(prefix(h[order], 1)):
                values[order[x:y]] = np.frombuffer(replies[kind, i], _value_type(kind))
            found.append((keys, values))
        counts = found[TOKENS][1]
        base = np.log10((counts + 0.1) / (n_tokens + 0.1 * (n_kinds + 1)))
        sizes, ((total,), (seen, unigram)) = sums(table.column("text"), token_key, [k for k, _ in found], [[found[GRAMS][1]], [(counts > 0).astype(float), base]])
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "n_tokens": pa.array(sizes[1], pa.int64()),
                "n_known": pa.array(seen.astype(np.int64)),
                "train_tokens": pa.array(np.full(len(total), n_tokens, np.int64)),
                "base_score": pa.array(unigram),
                "score": pa.array(total),
                "n_bytes": pa.array(sizes[0], pa.int64()),
                "bits_per_byte": pa.array(-total * np.log2(10) / np.maximum(sizes[0], 1)),
            }
        )

    blocks = docs.groupBy("block")
    frames = up(blocks.applyInArrow(ask, _ASK), levels, _merge_level(False), _ASK)
    replies = frames[-1].groupBy("kind", "bucket").cogroup(known.groupBy("kind", "bucket")).applyInArrow(_answer(upper), _REPLY)
    return blocks.cogroup(down(frames, replies, _unmerge, _REPLY).groupBy("block")).applyInArrow(
        finish, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    )


def held_out(folds: int):
    """Rows kept from training: crc32 of the doc_id as text, modulo ``folds``, is 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0


def op6_context_tree(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, ~held_out(10))
    return out.withColumn("held_out", held_out(10)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
