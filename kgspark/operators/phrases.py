"""Which of a stated list of phrases stand in texts: one pass over the texts for each block of phrases.

Phrases are read by the driver in blocks of bounded bytes, like any stated query set, and each block is searched with
one automaton, so the time of a text does not grow with the number of phrases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of phrases that are searched for at a time.
BLOCK_BYTES = 8 << 20


def blocks(phrases: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The distinct pairs of a table of phrases, as lists of bounded size."""
    pairs = phrases.select(key, text).where(F.col(text).isNotNull()).distinct()
    size = pairs.agg(F.sum(F.octet_length(text) + 16)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for b in range(n):
        yield [tuple(r) for r in (pairs.where(F.pmod(F.xxhash64(key, text), F.lit(n)) == b) if n > 1 else pairs).collect()]


def automaton(texts: list[str]):
    """A searcher for distinct texts that are not empty; its values are their places."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, t in enumerate(texts):
        if t:
            out.add_word(t, i)
    out.make_automaton()
    return out


def found_in(searcher, text: str) -> set[int]:
    return {i for _, i in searcher.iter(text)} if len(searcher) else set()


def match(rows: DataFrame, key: str, text: str, phrases: DataFrame, phrase_key: str, phrase: str, prepare: Callable | None = None, hits: Callable | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs (``key``, ``phrase_key``) of rows and the phrases that their text holds; null texts hold none, every text an empty phrase.

    ``hits(state, text)``, with ``state = prepare(pairs)`` made once a task, may replace the search by another rule.
    """
    out = None
    key_type, other_type = (f.schema[c].dataType.simpleString() for f, c in ((rows, key), (phrases, phrase_key)))
    for pairs in blocks(phrases, phrase_key, phrase, block_bytes):
        part = rows.select(key, text).mapInArrow(_searcher(pairs, prepare or _prepare, hits or _hits, key, phrase_key), f"`{key}` {key_type}, `{phrase_key}` {other_type}")
        out = part if out is None else out.union(part)
    return out


def _prepare(pairs: list[tuple]) -> tuple:
    texts = sorted({t for _, t in pairs})
    keys: dict = {t: [] for t in texts}
    for k, t in pairs:
        keys[t].append(k)
    return automaton(texts), [keys[t] for t in texts], keys.get("", [])


def _hits(state: tuple, text: str) -> list:
    searcher, keys, every = state
    return list(dict.fromkeys([k for i in sorted(found_in(searcher, text)) for k in keys[i]] + every))


def _searcher(pairs: list[tuple], prepare: Callable, hits: Callable, key: str, phrase_key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = prepare(pairs)
        for batch in batches:
            at, found = [], []
            for i, t in enumerate(batch.column(1)):
                if t.is_valid:
                    own = hits(state, t.as_py())
                    at += [i] * len(own)
                    found += own
            kind = pa.array([k for k, _ in pairs]).type if pairs else pa.null()
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, kind)], [key, phrase_key])

    return run
