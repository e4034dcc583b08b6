"""Blocks of documents that ask buckets of keys: how operators share corpus-wide facts without a broadcast.

Documents are dealt to blocks of about equal bytes. A block sends its distinct keys, packed, to FAN buckets; a bucket
sees every block's keys, so it can answer for the whole corpus, and the answers go back in the order asked. Where the
corpus has more keys than FAN buckets can hold, the messages of FAN blocks about one bucket are merged and sent on to
FAN buckets below it, and answers come back the same way. So the number of messages grows in proportion to the number
of blocks at every size, a message keeps its size, and a frequent key arrives at most once from each sender.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm._text import U

BLOCK_BYTES = 8 << 20
#: Bits of a key that one level of buckets tells apart.
FAN_BITS = 8
#: Keys of one bucket, at about six bytes of text a key.
BUCKET_KEYS = 2 << 20


def measured(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_keys: int = BUCKET_KEYS) -> tuple[int, int]:
    """How many blocks the texts of ``docs`` make, and how many levels of buckets hold their keys."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // block_bytes)), max(1, -(-(size // 6 // bucket_keys).bit_length() // FAN_BITS))


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_keys: int = BUCKET_KEYS, made: tuple[int, int] | None = None) -> tuple[DataFrame, int]:
    """``docs`` (doc_id, text) with a block number, and how many levels of buckets hold its keys; ``made``: from :func:`measured`."""
    blocks, levels = made or measured(docs, block_bytes, bucket_keys)
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))), levels


def up(asks: DataFrame, levels: int, merge: Callable, schema: str) -> list[DataFrame]:
    """Messages (kind, bucket, block and others) of each level; ``merge(level)`` makes those of a level from a table of the one above."""
    frames = [asks.withColumn("group", F.expr(f"block div {1 << FAN_BITS}"))]
    for level in range(1, levels):
        # A group's messages go on under its number.
        frames.append(frames[-1].groupBy("kind", "bucket", "group").applyInArrow(merge(level), schema).withColumn("group", F.expr(f"block div {1 << FAN_BITS}")))
    return frames


def down(frames: list[DataFrame], replies: DataFrame, unmerge: Callable, schema: str) -> DataFrame:
    """Replies to the first level's messages from those to the last one's; ``unmerge(level)`` maps a group's messages and replies."""
    for level in range(len(frames) - 1, 0, -1):
        back = replies.withColumn("over", F.shiftright("bucket", FAN_BITS)).groupBy("kind", "over", "block")
        replies = frames[level - 1].groupBy("kind", "bucket", "group").cogroup(back).applyInArrow(unmerge(level), schema)
    return replies


def prefix(keys: np.ndarray, level: int) -> np.ndarray:
    """Bucket of evenly spread keys on a level (from 1)."""
    return (keys >> U(64 - FAN_BITS * level)).astype(np.int64)


def split(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Bucket and slice of each run of equal values in sorted ``buckets``."""
    if len(buckets):
        cut = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]]))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield int(buckets[a]), a, b


def groups(sorted_keys: np.ndarray) -> np.ndarray:
    """First place of each distinct value."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def pack_bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def unpack_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)
