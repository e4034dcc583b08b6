"""Words of Arrow text columns as keyed 64-bit hashes, computed with numpy over whole batches.

A word is read eight bytes at a time and each part is mixed into the hash, which starts from the word's length and a
key; a word of over 64 bytes is hashed by blake2b with that key. A run of words is hashed as a tree of pairs. None of
the steps is a polynomial, so no pattern of letters makes words meet, and with a key that is drawn for a run nobody
can look for such words beforehand. Hashes find candidates; where a result depends on equality, words are compared
or a second key makes the hash 128 bits wide.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_ODD, _PAIR = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
#: Words up to so many bytes are hashed in numpy.
_LONG = 64
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


def draw_key() -> int:
    """A key for one run of an operator; drawn on the driver, so all its tasks and their repetitions share it."""
    return secrets.randbits(63)


def _separators(ranges: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes between words: white space; or all of ASCII but digits and lower-case letters.
SPACES = _separators([(0x09, 0x0D), (0x20, 0x20)])
NON_ALNUM = _separators([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits (a bijection)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int = 0) -> np.ndarray:
    """Hash of the bytes start to end of ``data`` for each span."""
    n = end - start
    h = mix(n.astype(U) * _ODD + U(key))
    if not len(h):
        return h
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    at, left = start, n
    where = None
    while True:
        part = mix((h if where is None else h[where]) ^ (eight[at] & _MASK[np.minimum(left, 8)]))
        if where is None:
            h = part
        else:
            h[where] = part
        more = np.flatnonzero((left > 8) & ((n if where is None else n[where]) <= _LONG))
        if not len(more):
            break
        at, left = at[more] + 8, left[more] - 8
        where = more if where is None else where[more]
    for i in np.flatnonzero(n > _LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=key.to_bytes(8, "big")).digest(), "big")
    return h


def same_words(one: Words, i: np.ndarray, two: Words, j: np.ndarray) -> np.ndarray:
    """Whether the words i of ``one`` are those j of ``two``, byte by byte."""
    n = one.end[i] - one.start[i]
    same = n == two.end[j] - two.start[j]
    at = np.flatnonzero(same)
    p, q, left = one.start[i][at], two.start[j][at], n[at]
    while len(at):
        differ = np.zeros(len(at), bool)
        for k in range(8):
            inside = k < left
            differ |= inside & (one.data[np.where(inside, p + k, 0)] != two.data[np.where(inside, q + k, 0)])
        same[at[differ]] = False
        more = ~differ & (left > 8)
        at, p, q, left = at[more], p[more] + 8, q[more] + 8, left[more] - 8
    return same


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order."""
    x = a * _PAIR
    x += b
    return mix(x)


class Words:
    """The words of some texts: ``hash`` per word, ``start``/``end`` bytes in ``data``, ``first[i]:first[i+1]`` the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool, key: int = 0):
        self.data = data = _LOWER[data] if lower else data
        self.key = key
        inside = ~separators[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | cut[:-1]))
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.hash = span_hash(data, self.start, self.end, key)
        self.first = np.searchsorted(self.start, offsets)
        self.texts = len(offsets) - 1

    def prefix(self, length: int) -> np.ndarray:
        """Hash of the first ``length`` bytes of each word, or of all of a shorter one."""
        return span_hash(self.data, self.start, np.minimum(self.end, self.start + length), self.key)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.texts), np.diff(self.first))

    def runs(self, *lengths: int) -> list[np.ndarray]:
        """For each length the hash of each run of so many words by its first word; runs may reach into the next text."""
        return run_hashes(self.hash, *lengths)


def run_hashes(words: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """Hashes of all runs of the given lengths: pairs, pairs of pairs and so on, joined to the length."""
    out: list = [None] * len(lengths)
    done = [0] * len(lengths)
    level, size = words, 1
    while True:
        for k, length in enumerate(lengths):
            if length & size:
                n = max(0, len(words) - done[k] - size + 1)
                out[k] = level[:n] if out[k] is None else pair(out[k][:n], level[done[k] : done[k] + n])
                done[k] += size
        if 2 * size > max(lengths):
            break
        level = pair(level[: max(0, len(level) - size)], level[size:])
        size *= 2
    return out


def whole_hash(words: np.ndarray, first: int, last: int) -> int:
    """Hash of a run of any length (used where a text is shorter than a shingle)."""
    h = np.full(1, last - first, U)
    for k in range(first, last):
        h = pair(h, words[k : k + 1])
    return int(h[0])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows first to last of a text column with their bytes and offsets, about ``size`` bytes at a time; no text is cut."""
    data, offsets = text_buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
