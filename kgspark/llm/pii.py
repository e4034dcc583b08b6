"""Personal data: fixed patterns, and terms that corpus co-occurrence shows to reveal what they protect."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm._blocks import groups
from kgspark.llm._shared import materialize, small_batches
from kgspark.llm._text import NON_ALNUM, Words, pieces

KINDS = ["email", "ip", "card", "phone", "term"]
#: Different texts in which a term must stand with an entity before its disclosure is estimated.
SUPPORT = 3
#: Share of an entity's information that a term gives away: generalised from the first on, removed from the second.
GENERALISE, REMOVE = 0.75, 0.95
#: A word of so many bytes or more that has both digits and letters is opaque: it may be a secret, if words before it say so.
OPAQUE = 16
#: Flagged terms are sent to all tasks up to so many; beyond, they are joined by shuffle.
SMALL = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """Start, kind, end and normal form of each match, leftmost and without overlap in each kind."""
    out = []
    done = 0
    at = text.find("@")
    while at >= 0:
        # The run before an @ holds no other @, so the match starts where the run does, or where the last one ended.
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end(), text[start : m.end()].lower()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.groups()):
                out.append((m.start(), 1, m.end(), m.group()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end(), digits))
        for m in _PHONE.finditer(text):
            digits = "".join(_DIGITS.findall(m.group()))
            if 9 <= len(digits) <= 15:
                out.append((m.start(), 3, m.end(), digits))
    return sorted(out)


_DIGIT, _LETTER = (np.array([bool(re.match(p, chr(c))) for c in range(256)]) for p in ("[0-9]", "[a-z]"))


def opaque(w: Words) -> np.ndarray:
    """Which words are opaque."""
    out = w.end - w.start >= OPAQUE
    for table in (_DIGIT, _LETTER):
        at = np.flatnonzero(out)
        total = np.concatenate([[0], np.cumsum(table[w.data], dtype=np.int32)]) if len(at) else np.zeros(1, np.int32)
        out[at] = total[w.end[at]] > total[w.start[at]]
    return out


def cues(w: Words) -> np.ndarray:
    """Opaque words that follow another word of their text, which may be the cue that they are secret."""
    at = np.flatnonzero(opaque(w))
    owner = np.searchsorted(w.first, at, "right") - 1
    return at[at > w.first[owner]]


class Visible:
    """Words of a text that no match overlaps: term (hash), start, end; and which of them are opaque after a ``cue``."""

    def __init__(self, text: str, spans: list[tuple]):
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        w = Words(raw, np.array([0, len(raw)]), NON_ALNUM, True)
        place = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        start, end = place[w.start], place[w.end]
        edge = np.zeros(len(start) + 1, np.int64)
        low, high = np.searchsorted(end, [s[0] for s in spans], "right"), np.searchsorted(start, [s[2] for s in spans], "left")
        np.add.at(edge, low, 1)
        np.add.at(edge, np.maximum(low, high), -1)
        keep = np.cumsum(edge)[:-1] == 0
        at = cues(w)
        at = at[keep[at]]
        self.term, self.start, self.end = w.hash.view(np.int64)[keep], start[keep], end[keep]
        self.cue, self.cue_start, self.cue_end = w.hash.view(np.int64)[at - 1], start[at], end[at]


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_ACTION = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("action", pa.string())])
_FOUND = "doc_id long, text_hash long, spans array<struct<start:long,kind:int,end:long>>"
_ACTIONS = "array<struct<start:long,end:long,action:string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of each row and, where it has any, their distinct values and the distinct terms of the text; opaque words with the word before each."""
    context = TaskContext.get()
    row = (context.partitionId() if context else 0) << 33
    for batch in batches:
        spans, terms, entities, words, before, value, counts = [], [], [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for text in batch.column(2):
            found = base_spans(text.as_py() or "")
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e, _ in found])
            entities.append(sorted({f"{KINDS[k]}:{v}" for _, k, _, v in found}))
            terms.append(np.unique(Visible(text.as_py(), found).term) if found else [])
        for _, _, data, offsets in pieces(batch.column(2)):
            w = Words(data, offsets, NON_ALNUM, True)
            at = cues(w)
            before.append(w.hash.view(np.int64)[at - 1])
            value.append(w.hash.view(np.int64)[at])
            counts.append(np.bincount(np.searchsorted(w.first, at, "right") - 1, minlength=w.texts))
            words += np.diff(w.first).tolist()
        pairs = pa.StructArray.from_arrays([np.concatenate(before), np.concatenate(value)], ["cue", "value"])
        yield pa.record_batch(
            [
                batch.column(0), batch.column(1), pa.array(spans, pa.list_(_SPAN)), pa.array(range(row, row + len(spans)), pa.int64()), pa.array(entities, pa.list_(pa.string())), pa.array(terms, pa.list_(pa.int64())),
                pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), pairs), pa.array(words, pa.int64()),
            ],
            ["doc_id", "text_hash", "spans", "row", "entities", "terms", "opaque", "words"],
        )
        row += len(spans)


def _occurrences(known: np.ndarray | None):
    """How often words stand in the texts of a batch: each of the sorted ``known``, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                h = Words(data, offsets, NON_ALNUM, True).hash.view(np.int64)
                term, n = np.unique(h if known is None else h[np.isin(h, known)], return_counts=True)
                yield pa.record_batch([pa.array(term), pa.array(n)], ["term", "n"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each term with the number of texts of a batch in which it stands outside matches."""
    for batch in batches:
        keys, counts, plain = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for text in batch.column(0):
            found = base_spans(text.as_py() or "")
            plain.append(not found)
            if found:
                keys.append(np.unique(Visible(text.as_py(), found).term))
                counts.append(np.ones(len(keys[-1]), np.int64))
        for _, _, data, offsets in pieces(batch.column(0).filter(pa.array(plain, pa.bool_()))):
            w = Words(data, offsets, NON_ALNUM, True)
            order = np.argsort(w.hash, kind="stable")  # texts stay in order within a term
            k, owner = w.hash[order].view(np.int64), w.owner()[order]
            first = groups(k)
            if len(first):
                new = np.concatenate([[True], (k[1:] != k[:-1]) | (owner[1:] != owner[:-1])]).astype(np.int64)
                keys.append(k[first])
                counts.append(np.add.reduceat(new, first))
        key, n = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        first = groups(key[order])
        if len(first):
            yield pa.record_batch([pa.array(key[order][first]), pa.array(np.add.reduceat(n[order], first))], ["term", "n"])


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in pieces(batch.column(2)):
            w = Words(data, offsets, NON_ALNUM, True)
            order = np.lexsort((w.hash, w.owner()))
            k, owner = w.hash[order].view(np.int64), w.owner()[order]
            new = np.flatnonzero(np.concatenate([np.ones(min(1, len(k)), bool), (k[1:] != k[:-1]) | (owner[1:] != owner[:-1])]))
            at = pa.array(owner[new] + first)
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(k[new])], ["doc_id", "text_hash", "term"])


def _places(flagged: np.ndarray, gone: np.ndarray, term: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[dict]:
    if not len(flagged) or not len(term):
        return []
    at = np.minimum(np.searchsorted(flagged, term), len(flagged) - 1)
    hit = flagged[at] == term
    return [{"start": s, "end": e, "action": "remove" if g else "generalise"} for s, e, g in zip(start[hit].tolist(), end[hit].tolist(), gone[at[hit]].tolist(), strict=True)]


def _split_flags(flags: list[tuple]) -> tuple[np.ndarray, ...]:
    """Sorted terms and what becomes of them, then sorted cues and what becomes of the words after them."""
    return tuple(np.array([x[k] for x in sorted(flags) if x[2] == cue], kind) for cue in (False, True) for k, kind in ((0, np.int64), (1, bool)))


def _mark(flags: list[tuple] | None = None):
    """Matches, places of flagged terms and opaque words after flagged cues in each text: of ``flags`` (term, gone, cue), or of those that its row brings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = None if flags is None else _split_flags(flags)
        names = None if every is None else np.unique(np.concatenate([every[0], every[2]]))
        for batch in batches:
            texts, spans, actions = batch.column(2).to_pylist(), [], []
            if every is None:
                flagged = [_split_flags([(y["term"], y["gone"], y["cue"]) for y in x]) if x else None for x in batch.column(3).to_pylist()]
            else:
                flagged = []
                for _, _, data, offsets in pieces(batch.column(2)):
                    w = Words(data, offsets, NON_ALNUM, True)
                    some = np.bincount(w.owner()[np.isin(w.hash.view(np.int64), names)], minlength=w.texts) > 0
                    flagged += [every if x else None for x in some.tolist()]
            for text, own in zip(texts, flagged, strict=True):
                found = base_spans(text or "")
                out = [{"start": s, "kind": k, "end": e} for s, k, e, _ in found]
                acts = []
                if own:
                    v = Visible(text, found)
                    places = {(x["start"], x["end"]): x for x in _places(*own[:2], v.term, v.start, v.end) + _places(*own[2:], v.cue, v.cue_start, v.cue_end)}
                    acts = [places[k] for k in sorted(places)]
                    out = sorted(out + [{"start": x["start"], "kind": 4, "end": x["end"]} for x in acts], key=lambda x: (x["start"], x["kind"], x["end"]))
                spans.append(out)
                actions.append(acts)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(spans, pa.list_(_SPAN)), pa.array(actions, pa.list_(_ACTION))], ["doc_id", "text_hash", "spans", "actions"])

    return run


def _secret_cues(docs: DataFrame, scan: DataFrame) -> DataFrame | None:
    """Words (term, gone) that reveal that the opaque word after them is secret; None if there are none to judge."""
    pairs = scan.select(F.explode("opaque").alias("p")).select("p.cue", "p.value")
    follow = pairs.groupBy("cue", "value").agg(F.count("*").alias("c")).groupBy("cue").agg(F.sum("c").alias("c"), F.count("*").alias("values")).where(F.col("values") >= SUPPORT)
    follow = materialize(follow.select(F.col("cue").alias("term"), "c"))
    n = follow.count()
    if not n:
        return None
    known = np.sort(np.array([r[0] for r in follow.select("term").collect()], np.int64)) if n <= SMALL else None
    counted = docs.select("text").mapInArrow(_occurrences(known), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    total, words = scan.agg(F.sum(F.size("opaque")), F.sum("words")).first()
    own = float(np.log2(max(2.0, words / total)))
    judged = follow.join(counted, "term").withColumn("disclosure", 1 + F.log2(F.col("c") / F.col("n")) / own)
    return judged.where(F.col("disclosure") >= GENERALISE).select("term", (F.col("disclosure") >= REMOVE).alias("gone"))


def _disclosing(docs: DataFrame, scan: DataFrame) -> DataFrame | None:
    """Terms over a threshold for some entity, and whether one of them is the upper (gone); None if no entity is judged."""
    rows = float(scan.count() or 1)
    held = scan.select("row", "text_hash", F.explode("entities").alias("entity"))
    own = F.greatest(F.log2(F.lit(rows) / F.col("f_entity")), F.lit(1.0))
    occurs = (
        held.groupBy("entity", "text_hash").agg(F.count("*").alias("c")).groupBy("entity").agg(F.sum("c").alias("f_entity"), F.count("*").alias("texts"))
        .where(F.col("texts") >= SUPPORT)
        .withColumn("own", own)
        # A term in more texts cannot reach the threshold, even if it stands in all of the entity's.
        .withColumn("most", F.col("f_entity") * F.pow(F.lit(2.0), (1 - GENERALISE) * F.col("own")) * (1 + 1e-9))
        .select("entity", "own", "most")
    )
    held = materialize(held.join(materialize(occurs), "entity"))
    if held.isEmpty():
        return None
    frequency = docs.select("text").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("f_term")).where(F.col("f_term") >= SUPPORT)
    limit = held.groupBy("row").agg(F.max("most").alias("limit"))
    terms = scan.select("row", "terms").join(limit, "row").select("row", "limit", F.explode("terms").alias("term"))
    terms = terms.join(frequency, "term").where("f_term <= limit").select("row", "term", "f_term")
    return (
        terms.join(held, "row")
        .where("f_term <= most")
        .groupBy("entity", "term", "text_hash").agg(F.count("*").alias("c"), F.first("f_term").alias("f_term"), F.first("own").alias("own"))
        .groupBy("entity", "term").agg(F.sum("c").alias("c"), F.count("*").alias("texts"), F.first("f_term").alias("f_term"), F.first("own").alias("own"))
        .where(F.col("texts") >= SUPPORT)
        .withColumn("disclosure", 1 + F.log2(F.col("c") / F.col("f_term")) / F.col("own"))
        .where(F.col("disclosure") >= GENERALISE)
        .groupBy("term").agg((F.max("disclosure") >= REMOVE).alias("gone"))
    )


def find(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every text of ``docs`` (doc_id, text).

    Returns doc_id, text_hash and spans (start, kind, end in code points; kind indexes KINDS; sorted) for each row,
    and disclosure spans' action (generalise or remove) in ``actions`` (start, end, action). Null and empty texts
    have no spans. Repeated rows give repeated rows. A null doc_id is kept.

    Protected entities are the patterns' matches by value, and secrets as a class. A term that stands in the texts of
    an entity discloses the share 1 + log p(entity | term) / -log p(entity) of the entity's information: the pointwise
    mutual information over the entity's own. Probabilities are shares of the rows whose text holds the entity or the
    term, at any distance. Only pairs that stand together in SUPPORT different texts are judged; a term over the
    threshold for any entity is flagged wherever it stands, in texts without the entity too, but within matches.

    An opaque word (OPAQUE bytes or more, with digits and letters) is nothing by itself. A word before it discloses the
    same share of the information that an opaque word comes next, probabilities being shares of words; it is judged
    if SUPPORT different opaque words follow it somewhere. Over the threshold it is a cue of secrets, and each opaque
    word after it is flagged as a term.

    An empty table gives no rows. A text is held whole while it is searched, however long it is.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    scan = materialize(docs.mapInArrow(_scan, f"{_FOUND}, row long, entities array<string>, terms array<long>, opaque array<struct<cue:long,value:long>>, words long"))
    terms, secret = _disclosing(docs, scan), _secret_cues(docs, scan)
    parts = [x.select("term", "gone", F.lit(cue).alias("cue")) for x, cue in ((terms, False), (secret, True)) if x is not None]
    flagged = materialize(parts[0].union(parts[-1]) if len(parts) == 2 else parts[0]) if parts else None
    n = flagged.count() if flagged else 0
    if not n:
        return scan.select("doc_id", "text_hash", "spans", F.array().cast(_ACTIONS).alias("actions"))
    if n <= SMALL:
        return docs.mapInArrow(_mark(sorted(map(tuple, flagged.collect()))), f"{_FOUND}, actions {_ACTIONS}")
    own = docs.mapInArrow(_distinct_terms, "doc_id long, text_hash long, term long").join(flagged, "term")
    own = own.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("term", "gone", "cue")).alias("own")).withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
    joined = docs.join(own, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left").select("doc_id", "text_hash", "text", "own")
    return joined.mapInArrow(_mark(), f"{_FOUND}, actions {_ACTIONS}")


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = {}
    for batch in batches:
        at = {n: i for i, n in enumerate(batch.schema.names)}
        texts = []
        for text, spans, actions in zip(batch.column(at["text"]).to_pylist(), batch.column(at["spans"]).to_pylist(), batch.column(at["actions"]).to_pylist(), strict=True):
            if text is None or not spans:
                texts.append(text)
                continue
            gone = {(a["start"], a["end"]) for a in actions if a["action"] == "remove"}
            out, done = [], 0
            for s in sorted(spans, key=lambda s: (s["start"], s["kind"])):
                if s["end"] <= done:
                    continue
                out.append(text[done : max(done, s["start"])])
                if s["kind"] < 4:
                    out.append(f"[{KINDS[s['kind']].upper()}]")
                elif (s["start"], s["end"]) not in gone:
                    out.append("[TERM]")
                done = s["end"]
            texts.append("".join(out) + text[done:])
        columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(i) for n, i in at.items() if n not in ("spans", "actions")]
        yield pa.record_batch(columns, [n for n in at if n not in ("spans", "actions")])


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind, and disclosing terms generalised or removed.

    All columns of ``docs`` are kept; one named spans, actions, text_hash, d or t does not disturb the work.
    """
    small_batches(docs.sparkSession)
    spans = find(docs).where(F.size("spans") > 0).groupBy("doc_id", "text_hash").agg(F.first("spans").alias("spans"), F.first("actions").alias("actions"))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    key = F.to_json(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")))
    # Other columns travel in one struct, so that none of their names can clash.
    packed = docs.select(key.alias("k"), "doc_id", "text", F.struct(F.lit(0).alias("no" + max(map(len, docs.columns)) * "_"), *rest).alias("rest"))
    spans = spans.select(F.to_json(F.struct("doc_id", "text_hash")).alias("k2"), "spans", "actions")
    joined = packed.join(spans, F.col("k") == F.col("k2"), "left").select("doc_id", "text", "spans", "actions", "rest")
    out = joined.mapInArrow(_replace, packed.select("doc_id", "text", "rest").schema)
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def _joined(spans):
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _number(spans, kind: int):
    """How many spans are of a kind; a second parameter of the lambda, even with a default, would be the place in the array."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def op1_pii(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda x: x["kind"] < 4)
    return found.select(
        "doc_id",
        *(_number("spans", k).alias(f"n_{n}") for k, n in enumerate(KINDS[:4])),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        _number("spans", 4).alias("n_term"),
    )
