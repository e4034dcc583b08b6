"""The pipeline's stages against what each is to keep, and the registry."""

import re
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from kgspark.llm import sharding
from test_operators import lower, shingles
from tests_support import TOXIC, write_tables


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    return write_tables(spark, str(tmp_path_factory.mktemp("tables")))


def test_stages_equal_brute_force(spark, folder):
    """What each stage keeps and writes, computed anew in Python on the stage's own input."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, kept[-1], folder)
        assert out.columns == columns
        kept.append(P.materialize(out))
    texts = [{r.doc_id: r.text for r in k.collect()} for k in kept]
    # Toxicity: held-out rows too; labels hold both classes.
    toxic = {i for i, t in texts[0].items() if t and any(w in t for w in TOXIC)}
    assert len(toxic) > 60 and set(texts[1]) == set(texts[0]) - toxic
    # Near duplicates: the smallest of each linked group.
    sets = {i: shingles(t) for i, t in texts[1].items()}
    low = {i: i for i in sets}
    for _ in range(3):
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    assert set(texts[2]) == {i for i in sets if low[i] == i} and not {4, 400, 401} & set(texts[2])
    # Benchmark passages.
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    item = words(spark.read.parquet(f"{folder}/benchmark.parquet").first().text)
    windows = {tuple(item[k : k + 10]) for k in range(len(item) - 9)}
    hit = {i for i, t in texts[2].items() if any(tuple(words(t)[k : k + 10]) in windows for k in range(len(words(t)) - 9))}
    assert hit == {6} and set(texts[3]) == set(texts[2]) - hit
    # Personal data; nothing else changes.
    assert texts[4] == {i: t and re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", t) for i, t in texts[3].items()}
    assert "[EMAIL]" in texts[4][7]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept[4].collect())
    # Packing: every token once, in windows without gaps.
    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    packed = P.run(spark, folder).collect()
    ids, windows = {}, {}
    for r in sorted(packed, key=lambda r: (r.doc_id, r.start)):
        own = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(own) == r.length and r.start == len(ids.setdefault(r.doc_id, []))
        ids[r.doc_id] += own
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert ids == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts[4].items()}
    for parts in windows.values():
        ends = np.cumsum([0, *(n for _, n in sorted(parts))]).tolist()
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024


def test_shards_by_their_law(spark, folder):
    """The query's rows against sizes, checksums and the law, computed in Python."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = sharding.op4_sampled_splitters(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    shards: dict = {}
    of_text: dict = {}
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        shards.setdefault(r.shard, []).append(r)
        of_text.setdefault(raw, set()).add(r.shard)
    sizes = {k: sum(r["size"] for r in rows) for k, rows in shards.items()}
    assert set(shards) == set(range(16)) and all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in shards.values())
    most = max(r["size"] for r in got)  # a shard is off by no more than a document and a part of a range
    assert max(sizes.values()) <= sum(sizes.values()) / 16 + 2 * most
    assert all(len(s) == 1 for s in of_text.values())


def test_repeated_rows_can_be_split(spark):
    rows = spark.range(4000).select(F.lit(1).cast("long").alias("id"), F.lit(7).cast("long").alias("key"), F.lit(10).cast("long").alias("size"), F.col("id").alias("serial"))
    got = sharding.range_shards(rows, shards=4).groupBy("shard").agg(F.sum("size").alias("bytes"), F.max("slot").alias("last"), F.count("*").alias("n")).collect()
    assert len(got) == 4 and max(r.bytes for r in got) <= 1.1 * 10_000 and all(r.last == r.n - 1 for r in got)


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_registry():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
