"""Hashes, messages over several levels, whole scores, secrets, and links in large buckets, against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import _blocks, _links, _text, ctw, decontam, neardup, pii, substring, toxicity
from test_operators import SCHEMA, WORDS, fixture_rows, lower, shingles


def thue_morse(n: int) -> tuple[str, str]:
    """Two words that any polynomial modulo a power of two maps to one value."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse(spark):
    x, y = thue_morse(1024)
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in rng.integers(0, 900, 70)]
    other = [y if w == "w1" else w for w in (["w1"] + words)]
    words = [x if w == "w1" else w for w in (["w1"] + words)]
    assert words != other
    docs = spark.createDataFrame([(1, " ".join([x] * 60)), (2, " ".join([y] * 60)), (3, " ".join(words)), (4, " ".join(other))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}[2] == 2
    items = spark.createDataFrame([(1, " ".join([x] * 12)), (2, x)], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontam.decontaminate(docs, items).collect()} == {1: 60, 2: 0, 3: words.count(x), 4: other.count(x)}
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(docs).collect()}[2] == 0


def test_words_compared_by_letters():
    texts = ["", "a", "ab", "x" * 8, "x" * 7 + "y", "x" * 64, "x" * 65, "x" * 64 + "y", "x" * 900, "é"]
    raw = np.frombuffer(" ".join(texts).encode(), np.uint8)
    w = _text.Words(raw, np.array([0, len(raw)]), _text.SPACES, False)
    n = len(w.hash)
    i, j = np.divmod(np.arange(n * n), n)
    assert (_text.same_words(w, i, w, j) == (i == j)).all() and len(set(w.hash.tolist())) == n
    again = _text.Words(raw, np.array([0, len(raw)]), _text.SPACES, False, key=5)
    assert not set(again.hash.tolist()) & set(w.hash.tolist())


def test_runs_of_words():
    h = np.arange(1, 200, dtype=np.uint64)
    for n, r in zip((1, 5, 25, 50, 300), _text.run_hashes(h, 1, 5, 25, 50, 300), strict=True):
        assert len(r) == max(0, 200 - n) and len(set(r.tolist())) == len(r)
    assert (_text.run_hashes(np.tile(h, 2), 5)[0][: len(h) - 4] == _text.run_hashes(h, 5)[0]).all()


@pytest.mark.parametrize("small, levels", [({"block_bytes": 3000, "bucket_keys": 40}, 1), ({"block_bytes": 200, "bucket_keys": 1}, 2)])
def test_messages_over_levels(spark, small, levels):
    """Two levels of buckets, several blocks to a group and several groups; the results do not change."""
    docs = spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3)
    assert _blocks.in_blocks(docs, **small)[1] == levels
    got = substring.remove_repeats(docs, **small)
    columns = ["doc_id", "n_words", "n_removed", "kept_text"]
    assert Counter(map(tuple, got.select(columns).collect())) == Counter(map(tuple, substring.remove_repeats(docs, bucket_keys=1 << 30).select(columns).collect()))
    one, two = ({r.doc_id: r for r in ctw.score(docs, F.col("doc_id") % 2 == 1, **x).collect()} for x in (small, {}))
    for i, r in one.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (two[i].n_tokens, two[i].n_known, two[i].train_tokens)
        assert r.score == pytest.approx(two[i].score, rel=1e-5) and r.base_score == pytest.approx(two[i].base_score)


def test_messages_grow_in_proportion():
    """Messages of a block do not depend on how many blocks there are."""
    import pyarrow as pa

    text = " ".join(f"w{k}" for k in np.random.default_rng(3).integers(0, 10**6, 20_000))
    table = pa.table({"doc_id": pa.array([1], pa.int64()), "text": [text]})
    for levels in (1, 2, 3):
        assert len(substring._Block(table, 50, levels, (1, 2)).ask_anchors(0)) == 1 << _blocks.FAN_BITS


@pytest.mark.parametrize("parts, flushes", [(1, 3000), (30, 100), (3000, 1)])
def test_last_level_messages_are_in_proportion(parts, flushes):
    """However blocks are spread over tasks, each level has about a FANth of the senders of the one above."""
    senders, fan = parts * flushes, 1 << _blocks.FAN_BITS
    numbers = {ctw.sender_number(p, k, senders) for p in range(parts) for k in range(flushes)}
    assert max(numbers) < senders and len(numbers) > 0.6 * senders
    first = {n // fan for n in numbers}
    assert len(first) <= -(-senders // fan) and len({n // fan for n in first}) <= -(-senders // fan**2)


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_last_level_messages_of_training(spark, partitions):
    """Three levels: messages of the last level for a kind and bucket, whatever the number of partitions."""
    docs = spark.createDataFrame(fixture_rows(), SCHEMA).repartition(partitions).select("text", F.lit(True).alias("train"))
    made = _blocks.measured(docs, 200)
    asks = _blocks.up(docs.mapInArrow(ctw._count(1, 200, made[0]), ctw._ASK), 3, ctw._merge_level(True), ctw._ASK)
    last = asks[-1].groupBy("kind", "bucket").count().agg(F.max("count")).first()[0]
    assert made[0] > 150 and last == 1


def test_three_levels(spark):
    docs = spark.createDataFrame(fixture_rows()[:14], SCHEMA).repartition(2)
    got = {r.doc_id: r for r in ctw.score(docs, F.col("doc_id") % 2 == 1, block_bytes=2000, bucket_keys=1).collect()}
    want = {r.doc_id: r for r in ctw.score(docs, F.col("doc_id") % 2 == 1).collect()}
    assert {i: r.n_known for i, r in got.items()} == {i: r.n_known for i, r in want.items()}
    assert all(r.score == pytest.approx(want[i].score, rel=1e-5) for i, r in got.items())


def test_scores_of_whole_texts(spark):
    train, d = ["abracadabra abra", "Cadabra  cab\n", ""], ctw.DEPTH
    texts = [*train, "abra zebra", "ü", None]
    form = lambda t: "\n" * d + " ".join(WORDS.findall(lower(t or ""))) + "\n"
    seen: dict = {}
    for t in train:
        b = form(t).encode()
        for j in range(d, len(b)):
            bits = f"{b[j]:08b}"
            for depth in range(d + 1):
                for k in range(8):
                    seen.setdefault((b[j - depth : j], bits[:k]), [0, 0])[int(bits[k])] += 1

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    memo: dict = {}

    def weighted(context, bits):
        if (context, bits) not in memo:
            own = kt(*seen[context, bits])
            if len(context) < d:
                inner = sum(weighted(c, b) for c, b in seen if b == bits and len(c) == len(context) + 1 and c[1:] == context)
                own = np.logaddexp(own, inner) - math.log(2)
            memo[context, bits] = own
        return memo[context, bits]

    def predict(context, bits, whole, bit):
        if (context, bits) not in seen:
            return None
        n = seen[context, bits]
        p = (n[bit] + 0.5) / (sum(n) + 1)
        below = predict(whole[len(whole) - len(context) - 1 :], bits, whole, bit) if len(context) < d else None
        if below is None:
            return p
        w = math.exp(kt(*n) - math.log(2) - weighted(context, bits))
        return w * p + (1 - w) * below

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in ctw.score(docs, F.col("doc_id") < len(train)).collect()}
    for i, t in enumerate(texts):
        b, total = form(t).encode(), 0.0
        for j in range(d, len(b)):
            bits = f"{b[j]:08b}"
            for k in range(8):
                p = predict(b"", bits[:k], b[j - d : j], int(bits[k]))
                total += math.log10(0.5 if p is None else p)
        assert got[i].score == pytest.approx(total, rel=1e-5), t
        assert got[i].n_bytes == len(b) - d


def test_cues_of_secrets(spark):
    hexes = [f"{k:08x}deadbeef{k:04d}cafe" for k in range(5)]
    rows = [(i, f'prose {i} with token = "{h}" and more') for i, h in enumerate(hexes)]
    rows += [(10 + i, f"commit {h[::-1]} is fine, a commit is a commit is a commit, so commit and commit") for i, h in enumerate(hexes)]
    rows += [(20, "token deadbeef00000000"), (21, "deadbeef00000000 alone"), (22, None), (23, "token"), (24, "plain words " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    for i, h in enumerate(hexes):
        assert [(s.start, s.end) for s in got[i].spans if s.kind == 4] == [(rows[i][1].index(h), rows[i][1].index(h) + len(h))]
        assert not got[10 + i].spans
    assert len(got[20].spans) == 1 and not got[21].spans and not got[23].spans
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert hexes[0] not in clean[0] and "token" in clean[0] and clean[21] == rows[-4][1]


def test_disclosure_by_its_formula(spark):
    """Flagged terms are those that a direct computation finds."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(80):
        words = [f"common{k}" for k in rng.integers(0, 12, 10)] + [f"mid{k}" for k in rng.integers(0, 60, 3)]
        if i % 8 == 0:
            words += ["bob@site.example", f"near{i % 24}", "mid3"] + (["always"] if i % 16 else [])
        rows.append((i, " ".join(rng.permutation(words))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n = len(rows)
    has = {i: set(t.split()) for i, t in rows}
    entity = {i for i, w in has.items() if "bob@site.example" in w}
    own = max(1.0, math.log2(n / len(entity)))
    flagged = set()
    for term in set().union(*has.values()) - {"bob@site.example"}:
        c, f = len({i for i in entity if term in has[i]}), len({i for i in has if term in has[i]})
        if c >= pii.SUPPORT and 1 + math.log2(c / f) / own >= pii.GENERALISE:
            flagged.add(term)
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    got = {t[s.start : s.end] for i, t in rows for s in found[i].spans if s.kind == 4}
    assert got == flagged and flagged and "common1" not in flagged


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(_links, "SMALL_BUCKET", 2)
    monkeypatch.setattr(_links, "BLOCK", 4)
    words = [f"t{i}" for i in range(120)]
    rows = [(k, " ".join([f"t{i}" if i >= 5 * k else f"v{k // 9}x{i}" for i in range(120)] if k else words)) for k in range(24)]
    rows += [(50, rows[3][1]), (50, "quite another text of some seven words"), (51, "quite another text of some seven words")]  # one doc_id, two texts
    links, sets = [], [(i, shingles(t)) for i, t in rows]
    for i, a in sets:
        links += [(i, j) for j, b in sets if a & b and 100 * len(a & b) >= 75 * len(a | b)]
    low = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == low


def test_convolution_by_its_formula():
    """Batched outputs equal those of each text alone, computed place by place."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 50, n)) for n in (1, 2, 30, 0, 200)]
    raw = "".join(texts).encode()
    x = toxicity.Texts(np.frombuffer(raw, np.uint8), np.cumsum([0, *map(len, texts)]))
    model = toxicity.Classifier(30)
    tables = model.tables() | {"buckets": np.unique(x.ids[x.ids != toxicity.PAD])[:28].astype(np.int32)}
    got = toxicity.logits(x, tables)
    for t in range(len(texts)):
        rows = toxicity.rows_of(x.ids[x.start[t] : x.start[t + 1]], tables["buckets"])
        hidden = []
        for w in toxicity.WIDTHS:
            places = [sum(model.p["emb"][rows[i + k]].sum(0) @ model.p[f"w{w}"][k] for k in range(w)) for i in range(len(rows) - w + 1)]
            hidden.append(np.maximum(np.max(places, 0) + model.p[f"b{w}"], 0))
        assert got[t] == pytest.approx(float(np.concatenate(hidden) @ model.p["out"] + model.p["bias"][0]), rel=1e-4, abs=1e-5)


def test_toxicity_of_repeated_rows(spark):
    rows = [(1, "the plain one", 9.0), (1, "the plain one", 9.0), (None, "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    assert sorted(map(tuple, toxicity.score(docs, {}).collect()), key=str) == sorted([(1, 0.0, 0), (1, 0.0, 0), (None, 0.0, 0)], key=str)
    assert toxicity.keep_clean(docs, {}).collect() == docs.collect()
