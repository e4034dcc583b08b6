"""Operators against brute force on a small fixture with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import _links, ctw, decontam, merkle, neardup, packing, pii, sharding, substring, toxicity, urls
from kgspark.llm._shared import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, kept string, block int, score double"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def fixture_rows():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary, n))
    base = make(160)
    shared = make(70)
    texts = [base, base, make(120), None, "", "one two", "one two", "  \n\t ", make(40) + " " + shared + " " + make(30), shared + "\n" + make(55)]
    words = base.split()
    for k in (1, 3, 8, 30):
        w = list(words)
        w[10 : 10 + k] = [f"changed{j}" for j in range(k)]
        texts.append(" ".join(w))
    texts += ["one<|endoftext|>two <|endoftext|>", "a b c d e f g h", "a b c d e f g h i", make(3000), "x" * 5000, "ümläut 😀 " * 20]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows.append(rows[2])  # a repeated row
    return [(i, t, "en", "s", len(t) if t is not None else None, "clash", "clash", 7, 0.5) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORDS.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(docs, empty):
    rows = {r[0]: r[1] for r in fixture_rows()}
    sets = {i: shingles(t) for i, t in rows.items()}
    parent = {i: i for i in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in rows:
        for b in rows:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(fixture_rows())
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicate_families_are_compared_in_blocks(spark, monkeypatch):
    """A chain of variants in which only neighbours are linked, so that one hub cannot connect them."""
    monkeypatch.setattr(_links, "BLOCK", 4)
    words = [f"t{i}" for i in range(120)]
    rows = [(k, " ".join(words[:12 * k] and [f"t{i}" if i >= 5 * k else f"v{k // 9}x{i}" for i in range(120)] or words)) for k in range(24)]
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    low = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == low


def test_common_sizes():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 5, 30, 50)]
    got = _links.common_sizes(sets, sets, width=7)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 102), (101, 103)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 104)}}


def test_remove_repeats(docs, empty):
    rows = fixture_rows()
    starts = defaultdict(set)
    for i, t, *_ in rows:
        w = WORDS.findall(t or "")
        for k in range(len(w) - 49):
            starts[tuple(w[k : k + 50])].add(i)
    want = Counter()
    for i, t, *_ in rows:
        w = WORDS.findall(t or "")
        gone = {p for k in range(len(w) - 49) if min(starts[tuple(w[k : k + 50])]) < i for p in range(k, k + 50)}
        want[i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)] += 1
    got = substring.remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert any(r.n_removed for r in got)
    assert substring.remove_repeats(empty).count() == 0


def test_decontaminate(spark, docs, empty):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    tokens = {r[0]: word.findall(lower(r[1] or "")) for r in fixture_rows()}
    long_doc = next(t for i, t in tokens.items() if len(t) > 1000)
    items = [(1, " ".join(long_doc[100:130])), (2, " ".join(long_doc[125:160])), (3, "One, TWO!"), (4, None), (5, "..."), (6, " ".join(long_doc[:9] + ["zzz"] * 8)), (3, "one two"), (None, "nothing here at all")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for d, t in tokens.items():
        hit, ids = set(), set()
        for i, x in items:
            w = word.findall(lower(x or ""))
            n = min(10, len(w))
            for s in range(len(w) - n + 1) if n else []:
                for k in range(len(t) - n + 1):
                    if t[k : k + n] == w[s : s + n]:
                        hit |= set(range(k, k + n))
                        ids.add("" if i is None else str(i))
        want[d] = (len(t), len(hit), sorted(ids))
    for block in (decontam.BLOCK_BYTES, 120):  # in one pass, and in several
        got = decontam.decontaminate(docs, table, block_bytes=block).collect()
        assert len(got) == len(fixture_rows())
        assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in got} == want
        assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in got)
    assert decontam.decontaminate(empty, table).count() == 0
    assert decontam.decontaminate(docs, table.limit(0)).where("n_hit > 0").count() == 0


def test_pack(docs, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids = {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in fixture_rows()}
    got = packing.pack(docs).collect()
    per_doc, windows = defaultdict(list), defaultdict(list)
    for r in got:
        own = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert own == ids[r.doc_id][r.start : r.start + r.length]
        assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(bytes(r.ids)), len(ids[r.doc_id]))
        per_doc[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    times = Counter(r[0] for r in fixture_rows())
    for d, parts in per_doc.items():
        assert sorted(p for s, n in parts for p in range(s, s + n)) == sorted(p for p in range(len(ids[d])) for _ in range(times[d]))
    assert set(per_doc) == set(ids)
    for parts in windows.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.pack(empty).count() == 0


def test_differencing_fills_windows():
    rng = np.random.default_rng(3)
    sizes = [n for _ in range(600) for n in packing.cut(int(rng.exponential(900)) + 1, 1024, 256)[1]]
    windows = packing.near_equal_windows(sizes)
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert max(sums) <= 1024 and sum(sums) / (1024 * len(sums)) > 0.97
    assert packing.differencing([8, 7, 6, 5, 4], 2) and packing.near_equal_windows([]) == []


def test_shards(spark, docs, empty):
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1).alias("size"))
    many = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.xxhash64("id")).alias("key"), (F.col("id") % 50 + 1).alias("size"))  # a third has one key
    for table, tight in ((rows, False), (many, True)):
        got = sharding.range_shards(table, shards=8, per_shard=32, sample=3000).collect()
        assert len(got) == table.count()
        slots, size = defaultdict(list), Counter()
        for r in got:
            slots[r.shard].append(r.slot)
            size[r.shard] += r["size"]
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        if tight:
            assert len(size) == 8 and max(size.values()) <= 1.08 * sum(size.values()) / 8
            shards_of = defaultdict(set)
            for r in got:
                shards_of[r.key].add(r.shard)
            assert all(len(s) == 1 for k, s in shards_of.items() if k != 5)
    none = empty.select(F.col("doc_id").alias("id"), F.lit(1).cast("long").alias("key"), F.lit(1).cast("long").alias("size"))
    assert sharding.range_shards(none).count() == 0


def test_context_tree(docs, empty):
    got = {r.doc_id: r for r in ctw.score(docs, docs.where("doc_id % 2 = 1")).collect()}
    train = [r for r in fixture_rows() if r[0] % 2 == 1]
    count = Counter(w for r in train for w in [*WORDS.findall(lower(r[1] or "")), None])
    n, v = sum(count.values()), len(count)
    for i, t, *_ in fixture_rows():
        words = [*WORDS.findall(lower(t or "")), None]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert got[i].base_score == pytest.approx(base)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(words), sum(count[w] > 0 for w in words), n)
        assert got[i].score < 0
    assert ctw.score(empty).count() == 0
    assert all(r.score < 0 for r in ctw.score(docs, empty).collect())  # nothing known: half a bit each


def test_context_tree_is_a_distribution():
    """After a context the 256 bytes' probabilities sum to one; and they follow the direct recursion."""
    text = b"\n" * ctw.DEPTH + b"abracadabra abracadabra cabra\n"
    d = ctw.DEPTH
    codes = Counter(int.from_bytes(bytes([*text[j - d : j][::-1], text[j]]), "big") for j in range(d, len(text)))
    keys = np.array(sorted(codes), np.uint64)
    counts = np.array([codes[int(k)] for k in keys])
    tree = ctw.Tree(keys, counts)
    nodes = ctw.parent_sums(tree)
    whole, weight = ctw.weighed(*nodes[1:])
    above = (nodes[0] >> 16 << 8) | (nodes[0] & 255)
    upper = ctw.upper_levels(above, nodes[1], nodes[2], whole)
    upper[2] = {"key": nodes[0].astype(np.uint64), "n0": nodes[1], "n1": nodes[2], "weight": weight}
    for context in (b"bracad", b"zzzzzz", b"\n\n\n\n\n\n"):
        head = int.from_bytes(context[-d:][::-1], "big") << 8
        p = 10 ** tree.log10(np.array([head | x for x in range(256)], np.uint64), upper)
        assert p.sum() == pytest.approx(1)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    def nodes(suffix, bits):
        out = [0, 0]
        for code, n in codes.items():
            raw = code.to_bytes(6, "big")
            s = f"{raw[-1]:08b}"
            if raw[: len(suffix)] == suffix and s.startswith(bits):
                out[int(s[len(bits)])] += n
        return out

    def weighted(suffix, bits):
        a, b = nodes(suffix, bits)
        if len(suffix) == d:
            return kt(a, b)
        below = {c.to_bytes(6, "big")[: len(suffix) + 1] for c in codes}
        inner = sum(weighted(s, bits) for s in below if s[: len(suffix)] == suffix and sum(nodes(s, bits)))
        return np.logaddexp(kt(a, b), inner) - math.log(2)

    def predict(suffix, bits, whole, bit):
        a, b = nodes(suffix, bits)
        p = ((b if bit else a) + 0.5) / (a + b + 1)
        if len(suffix) == d or not sum(nodes(whole[: len(suffix) + 1], bits)):
            return p
        w = math.exp(kt(a, b) - math.log(2) - weighted(suffix, bits))
        return w * p + (1 - w) * predict(whole[: len(suffix) + 1], bits, whole, bit)

    whole = b"bracad"[-d:][::-1]
    s = f"{ord('a'):08b}"
    want = sum(math.log10(predict(b"", s[:k], whole, int(s[k]))) for k in range(8))
    assert tree.log10(np.array([int.from_bytes(whole + b"a", "big")], np.uint64), upper)[0] == pytest.approx(want)


def test_pii_base_spans():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = np.random.default_rng(11)
    parts = ["a@b.c", "x.y%z@mail.example.com", "@", "a@b", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+49", "12", " ", "-", ".", "word", "é", "😀", "0", "+", "(", "5555555555554444"]
    for _ in range(400):
        text = "".join(rng.choice(parts, rng.integers(1, 12)))
        want = []
        for k, p in enumerate((email, ip, card, phone)):
            for m in p.finditer(text):
                digits = re.sub("[^0-9]", "", m[0])
                if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                    continue
                if k == 2:
                    total = sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(map(int, reversed(digits))))
                    if not 12 <= len(digits) <= 19 or total % 10:
                        continue
                if k == 3 and not 9 <= len(digits) <= 15:
                    continue
                want.append((m.start(), k, m.end()))
        assert [s[:3] for s in pii.base_spans(text)] == sorted(want), text


def test_pii_disclosure_and_sanitise(spark, docs, empty):
    secret = [(i, f"filler{i} noise{i} codename Falcon ann@corp.example says thing{i} number{i}", "x") for i in range(6)]
    common = [(100 + i, f"says the common thing{i} number and filler", "x") for i in range(40)]
    table = spark.createDataFrame([*secret, *common, (200, None, "x"), (201, "", "x")], "doc_id long, text string, spans string")
    out = {r.doc_id: r for r in pii.sanitise(table).collect()}
    assert len(out) == table.count()
    text = out[0].text
    assert "ann@" not in text and "[EMAIL]" in text and "Falcon" not in text and "codename" not in text  # stand only with the address
    assert "says" in text and "filler0" in text  # common, or too rare to judge
    assert out[100].text == common[0][1] and out[200].text is None and out[201].text == "" and out[0].spans == "x"
    found = {r.doc_id: r for r in pii.find(table).collect()}
    assert [s.kind for s in found[0].spans].count(4) >= 2 and not found[100].spans
    assert pii.find(docs).count() == len(fixture_rows()) and pii.find(empty).count() == 0 and pii.sanitise(empty).count() == 0


def test_merkle(spark, docs, empty):
    got = {r.doc_id: r for r in merkle.fingerprint(docs).collect()}
    texts = {r[0]: r[1] or "" for r in fixture_rows()}
    for a in texts:
        for b in texts:
            assert (got[a].fingerprint == got[b].fingerprint) == (texts[a] == texts[b])
    leaf = lambda x: hashlib.sha256(x.encode()).hexdigest()[:32]
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, t in texts.items():
        tree = [[[leaf(m) for m in re.findall(merkle.LEAF, p)] for p in s.split("\n")] for s in t.split("\n\n")]
        assert got[i].fingerprint == h("".join(h("".join(h("".join(p)) for p in s)) for s in tree))
    n = merkle.with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text").collect()
    order = sorted([(r[0], r[1] or "") for r in fixture_rows()], reverse=True)
    want = Counter((*x, y[1]) for x, y in zip(order, [*order[1:], order[0]], strict=True))
    assert Counter((r.doc_id, r.text, r.next_text) for r in n) == want
    assert merkle.with_next(empty.select("doc_id", "text"), "text").count() == 0
    ids = spark.range(9000).select((F.col("id") * 7 - 5000).alias("doc_id"), F.col("id").cast("string").alias("text"))
    assert merkle.with_next(ids, "text").where("next_text <> cast(if(text = '0', 8999, cast(text as int) - 1) as string)").count() == 0


def test_toxicity(spark, empty):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        words = [f"plain{k}" for k in rng.integers(0, 400, 40)]
        if toxic:
            words[int(rng.integers(0, 40))] = ["scoundrel", "Villain!", "cur" + str(rng.integers(0, 900))][i % 3] if i % 3 < 2 else f"dreadful{rng.integers(0, 900)}"
        rows.append((i, "the of and " + " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "the " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    tables = toxicity.train(docs, known.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in toxicity.score(docs, tables).collect()}
    test = [(got[i].predicted, y) for i, y in labels if i % 5 == 0]
    assert sum(p == y for p, y in test) / len(test) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert not got[1000].predicted and not got[1001].predicted
    clean = toxicity.keep_clean(docs, tables)
    assert {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if not r.predicted}
    assert toxicity.score(empty, tables).count() == 0
    assert toxicity.train(docs, known.limit(0)) == {} and toxicity.score(docs, {}).where("score > 0").count() == 0


def test_urls(spark):
    rows = [(1, "http://A.example.com/en/7"), (2, "https://x.com/en/1?q"), (3, None), (4, "nothing"), (5, "http://net/de/"), (6, "http://a.example.net/de/8#x"), (7, "http://comx/en/"), (8, "HTTP://b.org/es/?"), (8, "HTTP://b.org/es/?"), (9, "http://y.org/fr/")]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in rows], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    assert urls.judge(pages).count() == len(rows)
    assert [(got[i].rule, got[i].verdict) for i in (1, 2, 5, 6, 8)] == [("example.com/en/7", "allow"), ("com/en/", "block"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
    assert got[1].host == "a.example.com" and got[2].path == "/en/1" and (got[3].host, got[3].path, got[4].host) == ("", "", "")
    assert got[7].rule is None and got[9].verdict in ("allow", "block") and got[3].verdict in ("allow", "block")
    assert urls.judge(pages.limit(0)).count() == 0
