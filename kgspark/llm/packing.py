"""Packing token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import base64
import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm._shared import small_batches

CAPACITY = 1024
#: A document's tail is cut to pieces of at most so many tokens, so that windows hold several and come out near equal.
TAIL_PIECE = 256
#: Documents packed together: their tails share windows. Only the last set of a task is smaller.
DOCS_PER_SET = 1024
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Added tokens of the vocabulary, which are found inside texts.
MARKERS = {"<|endoftext|>": 50256}
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Items of each of ``windows`` sets with near-equal sums (the largest differencing method for many ways).

    A partial partition holds sorted sums. The two with the widest spread are merged with opposing imbalances:
    the fullest set of one joins the emptiest of the other. Only the sets that are not empty are stored.
    """
    heap: list[tuple] = []
    for i, size in enumerate(sizes):
        # spread, tie-break, sums in ascending order (missing ones are zero), items of each
        heap.append((-size, i, [size], [[i]]))
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a, ai = heapq.heappop(heap)
        _, _, b, bi = heapq.heappop(heap)
        if len(a) < len(b):
            a, ai, b, bi = b, bi, a, ai
        # b's sums from the largest meet a's from the smallest; a's missing sets are empty and come first.
        gap = windows - len(a)
        sums, items = a, ai
        if len(b) == 1:
            value, own = b[0], bi[0]
            if not gap:
                value, own = sums.pop(0) + value, items.pop(0) + own
            at = bisect.bisect_left(sums, value)
            sums.insert(at, value)
            items.insert(at, own)
        else:
            for k in range(len(b)):
                value, own = b[-1 - k], bi[-1 - k]
                if k < gap:
                    sums.append(value)
                    items.append(own)
                else:
                    sums[k - gap] += value
                    items[k - gap] = items[k - gap] + own
            order = sorted(range(len(sums)), key=sums.__getitem__)
            sums, items = [sums[k] for k in order], [items[k] for k in order]
        low = sums[0] if len(sums) == windows else 0
        heapq.heappush(heap, (-(sums[-1] - low), tick, sums, items))
        tick += 1
    return heap[0][3] if heap else []


def near_equal_windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """As few near-equal windows as differencing finds; their number rises while any exceeds the capacity."""
    if not sizes:
        return []
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, windows)
        over = max(sum(sizes[i] for i in w) for w in found) - capacity
        if over <= 0:
            return found
        windows += max(1, over * windows // (4 * capacity))


def cut(total: int, capacity: int, piece: int) -> tuple[int, list[int]]:
    """Full windows of a document and the pieces of its tail."""
    tail = total % capacity
    parts = -(-tail // piece)
    return total // capacity, [tail * (k + 1) // parts - tail * k // parts for k in range(parts)]


def _encoder(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=MARKERS)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, piece: int = TAIL_PIECE, with_ids: bool = True) -> DataFrame:
    """Pack the tokens of every document into sequences of at most ``capacity`` tokens.

    ``docs``: doc_id, text. A document's tokens are those of the byte-level vocabulary with its markers, then id 0 (so a null or
    empty text is one token). Returns a row per piece: doc_id, start (tokens of the document before it), length,
    ids_crc32, doc_tokens, sequence_id, offset and, if ``with_ids``, ids (little-endian unsigned 32-bit).
    Repeated rows are packed like any others; an empty table gives no rows.

    Whole windows of a document are sequences of their own. The tails of a set of documents that one task reads
    are cut to small pieces and divided by differencing. Texts and tokens are never shuffled; a task holds one
    set's tokens at a time. ``vocabulary`` is the place of a rank file; its default is looked up on each executor.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from public_tokenizers import path

        encoder = _encoder(vocabulary or path(VOCABULARY))
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 33
        tails: list[tuple] = []
        documents = 0

        def flush() -> Iterator[tuple]:
            nonlocal sequence, documents
            for window in near_equal_windows([len(t[4]) // 4 for t in tails], capacity):
                at = 0
                for i in window:
                    doc, start, total, crc, ids = tails[i]
                    yield doc, start, len(ids) // 4, crc, total, sequence, at, ids
                    at += len(ids) // 4
                sequence += 1
            tails.clear()
            documents = 0

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            nonlocal sequence, documents
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = encoder.encode(text.as_py() or "", allowed_special="all")
                tokens.append(0)
                ids = np.array(tokens, "<u4").tobytes()
                total = len(tokens)
                full, parts = cut(total, capacity, piece)
                for k in range(full):
                    own = ids[4 * k * capacity : 4 * (k + 1) * capacity]
                    yield doc, k * capacity, capacity, zlib.crc32(own), total, sequence, 0, own
                    sequence += 1
                start = full * capacity
                for n in parts:
                    own = ids[4 * start : 4 * (start + n)]
                    tails.append((doc, start, total, zlib.crc32(own), own))
                    start += n
                documents += 1
                if documents >= DOCS_PER_SET:
                    yield from flush()

        for batch in batches:
            yield from _record_batches(rows(batch), with_ids)
        yield from _record_batches(flush(), with_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES if with_ids else PIECES.replace(", ids binary", ""))


def _record_batches(rows: Iterator[tuple], with_ids: bool, size: int = 4096) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    kinds = [pa.int64()] * 7 + [pa.binary()]
    width = len(names) - (not with_ids)
    columns: list[list] = [[] for _ in range(width)]
    for row in rows:
        for c, v in zip(columns, row, strict=False):
            c.append(v)
        if len(columns[0]) >= size:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names[:width])
            columns = [[] for _ in range(width)]
    if columns[0]:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names[:width])


def op3_pack(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
