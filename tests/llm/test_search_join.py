"""Ranked search, fill-in-middle and the Jaccard join against brute force, with nulls, ties, repeated rows and clashing names."""

import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kgspark.llm import _links, fim, lexical, setjoin
from test_operators import SCHEMA, fixture_rows, lower, shingles


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows() + [(None, "one two seven", "en", "s", 1, "x", "y", 1, 0.1)] * 2, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


TERMS = re.compile("[0-9a-z\u0080-\U0010ffff]+")


def ranked(rows, items, k):
    """Every score by the formula, one document and item at a time."""
    terms = [TERMS.findall(lower(t or "")) for _, t in rows]
    n, tokens = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(t for ts in terms for t in set(ts))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERMS.findall(lower(t or "")))
    out = Counter()
    for i, wanted in asked.items():
        scores = []
        for (doc, _), ts in zip(rows, terms, strict=True):
            m, tf = 10 + 90 * len(ts) * n // max(1, tokens), Counter(ts)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in wanted if tf[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        for r, (s, null, doc) in enumerate(sorted(scores)[:k], 1):
            out[i, r, None if null else doc, -s] += 1
    return out


ITEMS = [(1, "One TWO word17"), (1, "word3é"), (2, None), (3, "!!"), (4, "word5 Word5 ümläut"), (None, "seven"), (5, "word1 word2 word4 word8 word9"), (5, "word1 word2 word4 word8 word9")]


@pytest.mark.parametrize("sizes", [{}, {"WINDOW": 4, "PART_DOCS": 9}, {"PART_BYTES": 700, "WINDOW": 1}])
def test_search(spark, docs, rows, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(lexical, name, value)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("terms", F.lit(1)).withColumn("score", F.lit(2))
    # Workers are forked: what is patched here does not reach them, so the parts are made and scored here.
    table = docs.select("doc_id", "text").toArrow().combine_chunks()
    batch = pa.record_batch([table.column(0).combine_chunks(), table.column(1).combine_chunks().cast(pa.string())], ["doc_id", "text"])
    index = pa.Table.from_batches(list(lexical._build(iter([batch.slice(0, 5), batch.slice(5)]))))
    assert sizes == {} or index.num_rows > 2
    for block_bytes in (lexical.BLOCK_BYTES, 40):
        got = lexical.search(spark.createDataFrame(index), items, 4, block_bytes)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(map(tuple, got.collect())) == ranked(rows, ITEMS, 4)


def test_windows_and_heaps(docs, rows):
    """Many windows of one part: the scorer itself, called with small windows."""
    table = docs.select("doc_id", "text").toArrow().combine_chunks()
    part = lexical._part(table.column(0).combine_chunks(), table.column(1).combine_chunks())
    n, tokens = part["docs"], part["tokens"]
    names = ["one", "two", "word17", "word5"]
    terms = [set(TERMS.findall(lower(t or ""))) for _, t in rows]
    df = [sum(x in ts for ts in terms) for x in names]
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df])
    state = type("Sent", (), {"value": (pa.array([x.encode() for x in names], pa.large_binary()), weight, [[0, 1, 2, 3]], n, tokens)})
    columns = ["ids", "known", "sizes", "terms", "ends", "df", "at", "tf"]
    batch = pa.record_batch([pa.array([part[c]], pa.binary()) for c in columns], columns)
    whole = lexical.WINDOW
    try:
        found = []
        for lexical.WINDOW in (1, 2, 7, whole):
            (out,) = lexical._scorer(state, 5)(iter([batch]))
            found.append(Counter((r["doc_id"], r["score"]) for r in out.to_pylist()))
    finally:
        lexical.WINDOW = whole
    assert found[0] == found[1] == found[2] == found[3]
    assert found[0] == Counter((d, s) for (_, _, d, s), c in ranked(rows, [(1, "one two word17 word5")], 5).items() for _ in range(c))


def test_search_of_nothing(spark, docs):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(lexical.build_index(none), items).count() == 0
    assert lexical.search(lexical.build_index(docs), items.where("false")).count() == 0
    assert lexical.search(lexical.build_index(docs.withColumn("text", F.lit(None).cast("string"))), items).count() == 0


def test_length_factor_of_very_long_texts():
    n, sizes = 25 * 10**9, np.array([0, 1, 10**9])
    assert lexical.length_factor(sizes, n, 10**14).tolist() == [10 + 90 * s * n // 10**14 for s in sizes.tolist()]


UNITS = {"line": re.compile(r"[^\n]*\n|[^\n]+"), "word": re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]*[\x20\x09-\x0D]*"), "character": re.compile(r".", re.S)}


def transformed(doc, text, unit, seed, rate, spm):
    text = text or ""
    if unit == "word":
        units = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|^[\x20\x09-\x0D]+", text)
        if len(units) > 1 and not units[0].strip():
            pass  # white space before the first word is a unit of its own
    else:
        units = UNITS[unit].findall(text)
    n = len(units)
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return (n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit, seed, rate, spm", [("line", 7, 100, 50), ("word", 1, 60, 0), ("character", 2, 100, 100)])
def test_fill_in_middle(spark, rows, unit, seed, rate, spm):
    rng = np.random.default_rng(4)
    extra = [(1000 + i, "".join(rng.choice(list("ab \n<é😀"), int(rng.integers(0, 60))))) for i in range(200)]
    extra += [(2000, "\n" * 9000), (2001, "x<P>y"), (2002, "<"), (2003, "<S"), (2004, "<P <S <M a\nb\n<S\n<\n"), (2005, "é\n" * 30_000), (2006, "y" * 40_000), (2007, "a\n<"), (2008, "P>")]
    every = rows + extra
    docs = spark.createDataFrame(every, "doc_id long, text string").withColumn("form", F.lit("clash")).withColumn("output", F.lit(3)).repartition(2)
    got = fim.fill_in_middle(docs, unit, seed, rate, spm)
    want = Counter((i, *transformed(i, t, unit, seed, rate, spm)) for i, t in every)
    assert Counter(map(tuple, got.collect())) == want
    assert Counter(r[0] for r in got.select(fim.restore(F.col("output"), F.col("form"))).collect()) == Counter(t or "" for _, t in every)
    assert fim.fill_in_middle(docs.where("false")).count() == 0


def test_chunks_of_any_size():
    text = "ab\n\ncd\né\n\n\nlast".encode()
    data, offsets = np.frombuffer(text + text, np.uint8), np.array([0, 0, len(text), 2 * len(text), 2 * len(text)])
    lines = [m.end() for m in re.finditer(rb"[^\n]*\n|[^\n]+", text)]
    for chunk in (1, 2, 3, 5, 100):
        u = fim.Units(data, offsets, "line", chunk)
        assert u.n.tolist() == [0, len(lines), len(lines), 0]
        for t in (1, 2):
            assert [u.cut(t, r) - offsets[t] for r in range(len(lines) + 1)] == [0, *lines]


def components(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    low = {i: i for i, _ in sets}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a & b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            low[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def near_rows(rng, n, words, vocabulary):
    """Families of texts, each a few changes away from another."""
    out = []
    while len(out) < n:
        base = [f"v{k}" for k in rng.integers(0, vocabulary, int(rng.integers(1, words)))]
        for _ in range(int(rng.integers(1, 7))):
            w = list(base)
            for _ in range(int(rng.integers(0, max(1, len(w) // 12) + 1))):
                w[int(rng.integers(0, len(w)))] = f"z{rng.integers(0, 9)}"
            out.append(" ".join(w[: len(w) - int(rng.integers(0, 3))] if len(w) > 8 else w))
            base = w
    return [(5000 + i, t) for i, t in enumerate(out[:n])]


@pytest.mark.parametrize("percent, words, vocabulary", [(80, 14, 30), (80, 160, 900), (60, 50, 100), (95, 300, 2000)])
def test_jaccard_join(spark, rows, percent, words, vocabulary):
    every = rows + near_rows(np.random.default_rng(words), 150, words, vocabulary) + [(5003, "other text of the same doc"), (None, None)]
    docs = spark.createDataFrame(every, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("id", F.lit("clash")).repartition(3)
    want = components(every, percent)
    got = setjoin.jaccard_join(docs, percent).collect()
    assert len(got) == len(every)
    assert {(r.doc_id, r.component_id) for r in got} == {(i, want.get(i)) for i, _ in every}
    sizes = Counter((i, len(shingles(t))) for i, t in every)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == sizes


def test_jaccard_join_over_levels(spark, rows):
    every = rows + near_rows(np.random.default_rng(9), 120, 60, 300)
    docs = spark.createDataFrame(every, "doc_id long, text string").repartition(2)
    want = components(every, 80)
    got = setjoin.jaccard_join(docs, block_bytes=3000, bucket_keys=1)
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(i, want.get(i)) for i, _ in every}
    assert setjoin.jaccard_join(docs.where("false")).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_no_pair_escapes(percent, sets_as_texts):
    """Any two sets similar enough share a key that one has in its index and the other looks for, without any verification."""
    rng = np.random.default_rng(percent)
    schemes = setjoin.Schemes(percent)
    seen = Counter()
    for _ in range(400):
        size = int(rng.choice([5, 6, 7, 8, 11, 19, 30, 60, 200, 700]))
        big = rng.integers(0, 2**63, size, np.int64).astype(np.uint64)
        apart = int(setjoin.most_apart(np.array([size]), percent)[0])
        lost = int(rng.integers(0, apart + 1))
        new = int(rng.integers(0, apart - lost + 1))
        small = np.concatenate([big[lost:], rng.integers(0, 2**63, min(new, lost), np.int64).astype(np.uint64)])
        sets = [np.sort(big), np.sort(small)]
        common = len(np.intersect1d(*sets))
        if not common or 100 * common < percent * (len(big) + len(small) - common) or not lost:
            continue
        sizes = np.array([len(s) for s in sets])
        own, nearby = schemes.of(sizes)
        reach = {int(s): (1 << 40, True) for s in np.concatenate([own, nearby])}
        blocks = []
        for s in sets:
            b = setjoin._Block.__new__(setjoin._Block)
            b.__init__(FakeTable([s]), percent, 0, schemes, reach)
            blocks.append(b)
        big_keys = set(blocks[0].keys[blocks[0].sought].tolist())
        assert big_keys & set(blocks[1].keys.tolist()), (size, lost, new)
        seen[size] += 1
    assert len(seen) >= 4


class FakeTable:
    """A block's table whose texts are already sets."""

    def __init__(self, sets):
        self.sets = sets

    def column(self, name):
        return pa.array(range(len(self.sets))) if name == "id" else self

    def take(self, order):
        return self


@pytest.fixture
def sets_as_texts(monkeypatch):
    real = setjoin.pieces
    monkeypatch.setattr(setjoin, "pieces", lambda column, *a: [(0, 1, column, None)] if isinstance(column, FakeTable) else real(column, *a))
    sets = setjoin.shingle_sets
    monkeypatch.setattr(setjoin, "shingle_sets", lambda d, o, key=0: d.sets if isinstance(d, FakeTable) else sets(d, o, key))


def test_refuted_candidate_hides_no_link():
    """Where the first pair of two components is refuted on its words, a later one still links them."""
    same = [f"w{i}" for i in range(40)]
    texts = ["other words " * 9, " ".join(same), "quite different text " * 9, " ".join(same[:-1])]
    table = pa.table({"id": [1, 2, 3, 4], "comp": [1, 1, 3, 3], "index": [0, 0, 1, 1], "low": [0] * 4, "high": [1] * 4, "text": texts})
    everything_meets = lambda d, o, key: [np.arange(40, dtype=np.uint64) for _ in range(len(o) - 1)]
    got = _links._compare_blocks(75, 0, everything_meets)(table)
    assert got.to_pylist() == [{"a": 2, "b": 4}]


def test_only_equal_trees_are_wholly_alike(spark):
    from kgspark.llm import merkle

    pairs = [("x one. x one. x one. y two.", "x one. y two."), ("a\n\nb", "b\n\na"), ("s t. " * 50, "s t. "), ("x\n\ny", "x\ny"), ("a. b. c.", "a. b. d."), ("", "a"), ("same. text", "same. text"), ("", "")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    a, b = merkle.tree(F.col("a")), merkle.tree(F.col("b"))
    got = [(r.x, r.y) for r in df.orderBy("i").select(merkle.likeness(a, b).alias("x"), merkle.likeness(b, a).alias("y")).collect()]
    assert all(x == pytest.approx(y) for x, y in got)
    assert all(0 <= x < 1 for x, _ in got[:6]) and got[6:] == [(1.0, 1.0)] * 2
    assert got[2][0] < 0.1 < got[0][0] < got[4][0] < got[1][0]
