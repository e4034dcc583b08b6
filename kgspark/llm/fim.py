"""Fill-in-the-middle transformation by overlapping chunks."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm._shared import small_batches
from kgspark.llm._text import SPACES, pieces

#: Bytes of a chunk, beside the one byte that it shares with the chunk before it.
CHUNK = 4096
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Whether a unit begins at a byte, told from it and the byte before it (in UTF-8).
BEGINS = {
    "line": lambda before, at: before == 10,
    "word": lambda before, at: SPACES[before] & ~SPACES[at],
    "character": lambda before, at: (at & 0xC0) != 0x80,
}
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Units:
    """The units of some texts: counted in chunks, found by their number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str, chunk: int = CHUNK):
        self.data, self.begins, self.offsets = data, BEGINS[unit], offsets
        chunks = -(-np.diff(offsets) // chunk)
        owner = np.repeat(np.arange(len(chunks)), chunks)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        self.low = offsets[owner] + place * chunk
        self.high = np.minimum(self.low + chunk, offsets[owner + 1])
        self.first = place == 0
        begin = self._begin(0, len(data))
        begin[offsets[:-1][chunks > 0]] = True
        count = np.add.reduceat(begin, self.low, dtype=np.int64) if len(self.low) else np.zeros(0, np.int64)
        self.before = np.cumsum(count) - count
        total = np.concatenate([[0], np.cumsum(count)])
        edge = np.concatenate([[0], np.cumsum(chunks)])
        self.base = total[edge[:-1]]
        self.n = total[edge[1:]] - self.base

    def _begin(self, low: int, high: int) -> np.ndarray:
        """Flags of the bytes low to high; only the byte before ``low`` is read besides."""
        at = self.data[low:high]
        before = self.data[max(0, low - 1) : high - 1]
        if len(before) < len(at):
            before = np.concatenate([at[:1], before])
        return self.begins(before, at)

    def cut(self, text: int, rank: int) -> int:
        """The byte after the first ``rank`` units of a text; only the chunk that owns the next one is read again."""
        if rank >= self.n[text]:
            return int(self.offsets[text + 1])
        rank += self.base[text]
        k = int(np.searchsorted(self.before, rank, "right")) - 1
        begin = self._begin(int(self.low[k]), int(self.high[k]))
        if self.first[k]:
            begin[0] = True
        return int(self.low[k] + np.flatnonzero(begin)[rank - self.before[k]])


def _marked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that hold one of the markers."""
    at = np.flatnonzero(data[:-2] == PREFIX[0]) if len(data) > 2 else np.zeros(0, np.int64)
    at = at[(data[at + 2] == PREFIX[2]) & np.isin(data[at + 1], [m[1] for m in (PREFIX, SUFFIX, MIDDLE)])]
    text = np.searchsorted(offsets, at, "right") - 1
    out = np.zeros(len(offsets) - 1, bool)
    out[text[at + 3 <= offsets[text + 1]]] = True
    return out


def _transform(unit: str, seed: int, rate: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in pieces(batch.column(1)):
                units, marked = Units(data, offsets, unit), _marked(data, offsets)
                rows = []
                for t, i in enumerate(batch.column(0).slice(first, last - first).to_pylist()):
                    low, high = int(offsets[t]), int(offsets[t + 1])
                    n = int(units.n[t])
                    h1, h2, h3, h4 = struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16])
                    if low == high or marked[t] or h3 % 100 >= rate:
                        rows.append((n, "plain", None, None, data[low:high].tobytes()))
                        continue
                    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
                    a, b = units.cut(t, one), units.cut(t, two)
                    prefix, middle, suffix = data[low:a].tobytes(), data[a:b].tobytes(), data[b:high].tobytes()
                    form = "spm" if h4 % 100 < spm else "psm"
                    parts = [SUFFIX, suffix, PREFIX, prefix] if form == "spm" else [PREFIX, prefix, SUFFIX, suffix]
                    chars = [int(np.count_nonzero((data[x:y] & 0xC0) != 0x80)) for x, y in ((low, a), (a, b))]
                    rows.append((n, form, *chars, b"".join([*parts, MIDDLE, middle])))
                n, form, prefix_chars, middle_chars, output = zip(*rows, strict=True)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(first, last - first), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix_chars, pa.int64()), pa.array(middle_chars, pa.int64()),
                        pa.array(output, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """Cut each text into prefix, middle and suffix at units drawn from its doc_id, and put the middle last.

    ``docs``: doc_id, text; other columns are ignored, so none can clash. ``unit``: line (with its line feed), word
    (with the white space after it) or character. Returns doc_id, n (units), form, prefix_chars, middle_chars, output:
    ``<P>prefix<S>suffix<M>middle`` (psm), ``<S>suffix<P>prefix<M>middle`` (spm, ``spm`` of 100) or the text itself
    (plain: empty texts, texts with a marker, and all but ``rate`` of 100). One row for each row: a null text is
    empty, repeated rows give equal rows, rows of one doc_id share their draws, a null doc_id draws as the empty
    string, an empty table gives no rows. No order matters, so there are no ties.

    A text is read as chunks of 4 KiB that overlap by one byte, so that each chunk alone sees where units begin. The
    beginnings are counted for all chunks of a batch at once, prefix sums tell which chunk owns each cut, and only
    that chunk is read again. A text of any length is cut whole; a task holds about a MiB of texts, or one longer one.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_transform(unit, seed, rate, spm), OUT)


def restore(output: Column, form: Column) -> Column:
    """The text from an output and its form."""
    p, s, m = (F.instr(output, x.decode()) for x in (PREFIX, SUFFIX, MIDDLE))
    part = lambda low, high: F.substring(output, low + 3, high - low - 3)
    middle = F.substring(output, m + 3, F.length(output))
    return F.when(form == "psm", F.concat(part(p, s), middle, part(s, m))).when(form == "spm", F.concat(part(p, m), middle, part(s, p))).otherwise(output)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
drawn AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || x[9:16] AS BIGINT) % (len(u) + 1) AS b,
    CAST('0x' || x[17:24] AS BIGINT) % 100 AS r, CAST('0x' || x[25:32] AS BIGINT) % 100 AS s FROM units),
cut AS (
  SELECT doc_id, t, n, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS f,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r >= 100 THEN 'plain' WHEN s < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || f || '<M>' || m ELSE '<S>' || f || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM cut
"""
