"""Links between documents that share buckets: exact sets of shingles, and components without pairs of copies.

Candidates come from an operator as rows of buckets. Every link is confirmed on the full sets, word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm._shared import connected_components, materialize
from kgspark.llm._text import SPACES, U, Words, draw_key, pieces, whole_hash

SHINGLE = 5
DIGEST = ["n_shingles", "digest", "digest2"]
#: Pairs of documents of a bucket up to this size are confirmed one by one; of a larger one, documents are compared in
#: blocks of about so many documents and bytes of text.
SMALL_BUCKET, BLOCK, BLOCK_BYTES = 32, 512, 4 << 20
#: Bytes of text of the pairs that are confirmed together.
CONFIRM_BYTES = 1 << 20
_LOWER_BYTES = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, key: int = 0) -> list[np.ndarray]:
    """Sorted distinct hashes of the five-word shingles of each text; a shorter text is one shingle, an empty one has none."""
    w = Words(data, offsets, SPACES, True, key)
    (h,) = w.runs(SHINGLE)
    count = np.diff(w.first)
    out = []
    for i in range(w.texts):
        if count[i] >= SHINGLE:
            s = np.sort(h[w.first[i] : w.first[i + 1] - SHINGLE + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(np.array([whole_hash(w.hash, w.first[i], w.first[i + 1])] if count[i] else [], U))
    return out


def digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """A 128-bit digest of each set, in two columns."""
    both = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def equal_sets(sketch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, id, DIGEST) of the classes of equal sets, ``id`` the smallest doc_id of each; and the classes' own rows of ``sketch``.

    A doc_id that comes with several sets has a row for each of them.
    """
    filled = sketch.where("n_shingles > 0 and doc_id is not null")
    # Written, so that Spark can split the join at a class of very many copies.
    classes = materialize(filled.groupBy(*DIGEST).agg(F.min("doc_id").alias("id")))
    member = materialize(filled.select("doc_id", *DIGEST).join(classes, DIGEST).select("doc_id", "id", *DIGEST))
    first = member.where("doc_id = id").select("id", *DIGEST).distinct()
    return member, filled.withColumnRenamed("doc_id", "id").join(first, ["id", *DIGEST], "left_semi").dropDuplicates(["id", *DIGEST])


def own_links(member: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that a doc_id with different sets holds together."""
    return member.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("a", "b")


def labelled(sketch: DataFrame, member: DataFrame, comp: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``sketch``."""
    low = member.join(comp, "id", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "id")).alias("component_id"))
    return sketch.select("doc_id", "n_shingles").join(low, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each distinct pair."""
    return np.unique(a * (b.max(initial=0) + 1) + b, return_inverse=True)[1]


def exact_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted numbers of the distinct shingles of each text: equal numbers mean equal words, letter by letter."""
    words = [t.translate(_LOWER_BYTES).split() for t in texts]
    number: dict = {}
    one = np.array([number.setdefault(w, len(number)) for ws in words for w in ws], np.int64)
    n = max(0, len(one) - SHINGLE + 1)
    two = _ranks(one[:-1], one[1:])
    four = _ranks(two[:-2], two[2:])
    five = _ranks(four[:n], one[SHINGLE - 1 :][:n])
    out, at, short = [], 0, {}
    for ws in words:
        if len(ws) >= SHINGLE:
            out.append(np.unique(five[at : at + len(ws) - SHINGLE + 1]))
        else:
            out.append(np.array([-1 - short.setdefault(tuple(ws), len(short))] if ws else [], np.int64))
        at += len(ws)
    return out


def linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(one, two, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(one) + len(two) - common)


def _confirm(percent: int):
    """Keep the pairs (a, b, text_a, text_b) whose sets of shingles, compared word by word, are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, first = [], 0
            size = np.cumsum(pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3))).to_numpy(zero_copy_only=False))
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + CONFIRM_BYTES, "right")))
                number: dict = {}
                pairs = [[number.setdefault(t.as_py().encode("utf-8", "surrogatepass"), len(number)) for t in batch.column(k).slice(first, last - first)] for k in (2, 3)]
                sets = exact_sets(list(number))
                keep += [linked(sets[x], sets[y], percent) for x, y in zip(*pairs, strict=True)]
                first = last
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked; ``texts``: id, text of every candidate."""
    joined = (
        pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )
    return joined.mapInArrow(_confirm(percent), "a long, b long")


def common_sizes(left: list[np.ndarray], right: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right``."""
    out = np.zeros((len(left), len(right)), np.float32)
    both = np.intersect1d(np.concatenate([np.zeros(0, U), *left]), np.concatenate([np.zeros(0, U), *right]))
    places = [[(i, np.searchsorted(both, s[np.isin(s, both, assume_unique=True)])) for i, s in enumerate(side)] for side in (left, right)]
    for at in range(0, len(both), width):
        m = [np.zeros((len(side), min(width, len(both) - at)), np.float32) for side in (left, right)]
        for x, side in zip(m, places, strict=True):
            for i, p in side:
                x[i, p[(p >= at) & (p < at + width)] - at] = 1
        out += m[0] @ m[1].T
    return out


def _compare_blocks(percent: int, key: int, sets_of=shingle_sets):
    """Links between the two blocks of a task, or within its only one: of those that connect the same components, the first that holds.

    Hashes only say which pairs to look at: a pair stands for its components once its words are compared.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, comp, index, low, high = (table.column(c).to_numpy() for c in ("id", "comp", "index", "low", "high"))
        texts = table.column("text")
        sets = [s for _, _, d, o in pieces(texts) for s in sets_of(d, o, key)]
        links, parent = [], {}

        def find(c: int) -> int:
            while (up := parent.setdefault(c, c)) != c:
                parent[c] = c = parent[up]
            return c

        one, two = np.flatnonzero(index == low), np.flatnonzero(index == high)
        if len(one) and len(two):
            common = common_sizes([sets[i] for i in one], [sets[i] for i in two])
            size = np.array([len(s) for s in sets], np.int64)
            union = size[one][:, None] + size[two][None] - common
            near = (common > 0) & (100 * common >= percent * union) & (comp[one][:, None] != comp[two][None])
            for x, y in np.argwhere(np.triu(near) if low[0] == high[0] else near).tolist():
                a, b = find(int(comp[one[x]])), find(int(comp[two[y]]))
                if a != b and linked(*exact_sets([texts[int(i)].as_py().encode("utf-8", "surrogatepass") for i in (one[x], two[y])]), percent):
                    parent[max(a, b)] = min(a, b)
                    links.append((int(ids[one[x]]), int(ids[two[y]])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def _between_components(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components within large buckets; ``members``: key, id, comp, bytes.

    The documents of a bucket that fits one block are compared in a task. Of a larger one the largest component's
    documents are compared with all others, and those among themselves, in blocks: a task has two blocks, and a
    document goes to as many tasks as its bucket has blocks to compare it with. No pair of documents is a row.
    """
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "comp", "bytes")).alias("m"), F.sum("n").alias("total"), F.sum("bytes").alias("bytes"))
    many = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES))
    one = many(F.col("total"), F.col("bytes")) <= 1
    others, mains = many(F.col("total") - F.col("m.n"), F.col("bytes") - F.col("m.bytes")), many(F.col("m.n"), F.col("m.bytes"))
    blocks = main.where("total > m.n").select("key", F.when(~one, F.col("m.comp")).alias("main"), F.when(one, 1).otherwise(others).alias("others"), F.when(one, 0).otherwise(mains).alias("mains"))
    is_main = F.col("comp").eqNullSafe(F.col("main"))
    at = F.pmod(F.xxhash64("id"), F.when(is_main, F.col("mains")).otherwise(F.col("others")))
    dealt = (
        members.join(materialize(blocks), "key")
        .withColumn("index", F.when(is_main, F.col("others") + at).otherwise(at))
        .withColumn("partner", F.explode(F.sequence(F.lit(0).cast("long"), F.when(is_main, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1))))
        .select("key", "id", "comp", "index", F.least("index", "partner").alias("low"), F.greatest("index", "partner").alias("high"))
    )
    return dealt.join(texts.select("id", "text"), "id").groupBy("key", "low", "high").applyInArrow(_compare_blocks(percent, draw_key()), "a long, b long")


def sizes_allow(one, two, percent: int):
    """Whether sets of two sizes can be similar enough."""
    return 100 * F.least(one, two) >= percent * F.greatest(one, two)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text of the documents named in ``ids`` (id), equal ones once; written."""
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), "text").join(ids.distinct(), "id")
    return materialize(texts.withColumn("sha", F.sha2("text", 256)).dropDuplicates(["id", "sha"]).drop("sha"))


def components(first: DataFrame, bucket: DataFrame, own: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Columns (id, component) of all documents that are linked with another one.

    ``bucket``: key, id, n (rows of the key), size (of the set) and bytes (of the text), written; ``first``: pairs (a, b) to confirm before
    all others, one for each document at most; ``own``: pairs that belong together without a test; ``texts``: from :func:`texts_of`.

    After the first pairs, only the buckets that still span several components are looked at, and their documents
    compared across components: pair by pair in a small bucket, in blocks in a large one, of buckets with the same
    documents only once. Thus no two documents that share a bucket go unexamined unless they are already connected,
    and the pairs within a group are never expanded to rows.
    """
    first = materialize(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = materialize(verified(first, texts, percent).union(own))
    comp = materialize(connected_components(links).withColumnsRenamed({"component": "comp"}))
    at = materialize(bucket.join(comp, "id", "left").select("key", "id", "n", "size", "bytes", F.coalesce("comp", "id").alias("comp")))
    # Of buckets with the same documents the one with the smallest key stays.
    same = F.struct(F.col("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("id", F.lit("x"))).alias("x"))
    mixed = at.groupBy("key", "n").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), same.alias("same")).where("lo <> hi").groupBy("same").agg(F.min("key").alias("key"))
    rest = materialize(at.join(mixed.select("key"), "key", "left_semi"))
    few = rest.where(F.col("n") <= SMALL_BUCKET)
    side = lambda x: few.select("key", F.col("id").alias(x), F.col("comp").alias(f"comp_{x}"), F.col("size").alias(f"size_{x}"))
    pairs = side("a").join(side("b"), "key").where(F.expr("a < b and comp_a <> comp_b") & sizes_allow(F.col("size_a"), F.col("size_b"), percent))
    pairs = pairs.select("a", "b").distinct().join(first, ["a", "b"], "left_anti")
    large = _between_components(rest.where(F.col("n") > SMALL_BUCKET).drop("n", "size"), texts, percent)
    links = materialize(links.union(verified(pairs, texts, percent)).union(large))
    return connected_components(links).select("id", "component")
