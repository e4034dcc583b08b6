"""Registry, workflows, discovery and extraction on literal cases."""

import datetime
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.functions import ids as Ids
from kgspark.functions import json as J
from kgspark.functions.text import item_matched
from kgspark.operators import chunks as C
from kgspark.operators import extraction as E
from kgspark.operators import graph as G
from kgspark.operators import grouping as Gr
from kgspark.operators import metrics as M
from kgspark.operators import registry as R
from kgspark.operators import workflows as W
from kgspark.operators.phrases import match
from kgspark.sources import discovery as D
from kgspark.sources import tables as S
from kgspark.streaming import incremental as I


def test_registry_versions(spark):
    reg = R.new(spark)
    ents = spark.createDataFrame([("Person", ""), ("Person", "again")], R.ENTITY_TYPES)
    rels = spark.createDataFrame([("WORKS_ON", ["Person"], ["*"], False)], R.RELATIONSHIP_TYPES)
    at = datetime.datetime(2024, 1, 1)
    one = R.update(reg, ents, rels, "first", at)
    assert one["entities"].count() == 1 and one["history"].first().version == 2
    assert R.update(one, ents, rels, "again", at) is one
    assert R.valid_relationships(one["relationships"], "Person", "Anything").count() == 1
    assert R.valid_relationships(one["relationships"], "Project", "Person").count() == 0


def test_first_owner_claims(spark):
    m = spark.createDataFrame([("1", None, "c", "a", "Sprint Review notes"), ("2", "1", "c", "b", "and the Roadmap"), ("3", None, "c", "a", "Roadmap"), ("4", None, "c", "a", "other")], "ts string, thread_ts string, channel string, user string, text string")
    o = spark.createDataFrame([("page", 2, 1, "Roadmap"), ("meeting", 1, 5, "Sprint Review")], "owner string, phase int, ord int, phrase string")
    assert {r.thread_id: r.owner for r in W.claim_threads(o, m).collect()} == {"1": "meeting", "3": "page"}
    got = {r.owner: r for r in W.workflows(o, m).collect()}
    assert got["meeting"].total_messages == 2 and got["meeting"].participants == 2 and got["page"].total_records == 2
    assert W.workflows(o, m.limit(0)).count() == 0
    meetings = spark.createDataFrame([(1, "Daily Standup"), (2, "Lunch")], "recording_id int, title string")
    assert [x.count() for x in W.work_context(meetings, meetings)] == [1, 1]
    assert W.weighted_pick(spark.range(100).withColumn("w", F.col("id")), "w", 10, "id").count() == 10


def test_discovery():
    raw = '{"items": [{"id": 1, "sub": {"user_id": "u"}}, {"id": ""}], "deep": {"a": {"b": {"c": {"id": 5}}}}, "name": "n"}'
    found = D.ids_in(raw)
    assert [(x["path"], x["value"]) for x in found] == [("items[0].id", "1"), ("items[0].sub.user_id", "u"), ("deep.a.b.c.id", "5")]
    assert D.ids_in("nonsense") == [] and D.ids_in(None) == []
    assert D.array_paths(raw) == ["items"]
    assert D.coerce_params({"a": "5", "b": 5, "c": "true", "d": "x", "e": None}, {"a": "integer", "b": "string", "c": "boolean", "d": "number"}) == {"a": 5, "b": "5", "c": True, "d": "x", "e": None}
    assert D.deep_merge({"a": {"b": 1, "l": [1]}, "x": 1}, {"a": {"c": 2, "l": [2]}, "x": [3]}) == {"a": {"b": 1, "l": [1, 2], "c": 2}, "x": [3]}
    with pytest.raises(ValueError):
        D.seeds(None)
    assert D.seeds(["a"]) == ["a"] and D.seeds(None, required=False) == []


def test_extraction_statuses(spark):
    def model(text):
        if text == "fail":
            raise RuntimeError("no")
        if text == "list":
            return {"entities": [{"name": f"n{i}", "type": "T", "description": ""} for i in range(60)], "relationships": []}
        return E.dictionary_extractor({"Ann": "Person", "Bob": "Person", "!!!": "X"})(text)

    r = spark.createDataFrame([("1", "c", "Ann met Bob"), ("2", "c", "fail"), ("3", "c", "list"), ("4", "c", "nothing"), ("5", "c", "  "), ("6", "c", None), ("7", "c", "Bob saw Ann, !!!")], "_id string, checksum string, content string")
    g = E.index_graph(r, model)
    assert {x.record_id: x.status for x in g["status"].collect()} == {"1": "success", "2": "failed", "3": "toxic", "4": "empty", "7": "success"}
    assert g["nodes"].count() == 2 and g["edges"].count() == 2 and g["mentions"].count() == 4
    assert {x.status: x.n for x in E.statistics(g["results"], 2.0).collect()}["success"] == 2


def test_existence_and_pages(spark):
    e = spark.createDataFrame([("a1", "T", "b", None), ("a2", "T", "b", 0.5), ("c", "T", "b", 0.0)], "src string, type string, dst string, confidence double")
    n = spark.createDataFrame([("a1", "L", "t")], "id string, label string, title string")
    assert G.existing_ids(spark.createDataFrame([("a1",), ("x",)], "id string"), n).count() == 1
    assert G.existing_edges(e.select("src", "type", "dst"), e.where("src = 'c'")).count() == 1
    assert [r.confidence for r in G.edges_from(e, "a").collect()] == [1.0, 0.5] and G.edges_from(e, "a", 1, 1).first().src == "a2"
    ents = spark.createDataFrame([("z", "Tag", "Z"), ("z", "Tag", "Z")], "id string, type string, title string")
    nodes, edges = G.index_config_entities(n, e, ents, e.where("src = 'c'"))
    assert nodes.count() == 2 and edges.count() == 3


def test_metrics_bundle(spark):
    got = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b")], "query string, pos int, id string")
    want = spark.createDataFrame([("q", "a")], "query string, id string")
    m = M.evaluate(got, want)
    assert m.first().jaccard == 0.5 and M.formatted(m, ["precision", "mrr"]).first().line == "precision: 0.500, mrr: 1.000"


def test_refresh_embeddings(spark):
    meta = spark.createDataFrame([("1", "Ann", "Person", None, None)], "id string, name string, type string, description string, embedded_checksum string")
    one = C.refresh_embeddings(meta)
    assert one.count() == 1
    done = meta.drop("embedded_checksum").join(one.select("id", "embedded_checksum"), "id")
    assert C.refresh_embeddings(done).count() == 0


def test_matched_items_equals_comparing_every_pair(spark):
    texts = ["the brown fox jumps over lazy dogs and runs", "xthe brown fox jumpsy", "fox", "", None, "of a b", "one two three four five six seven", "one, two! three four five", "one two three four five", "(The) Brown\n fox jumps"]
    wanted = [*texts, "brown", "own fo", "a b", "six one two three", "five four three two one", "one one one six six six nine"]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, "brown fox")], "doc_id int, text string")
    items = spark.createDataFrame([*((str(k), t) for k, t in enumerate(wanted)), ("3", wanted[3])], "item_id string, text string")
    pairs = docs.join(items.withColumnRenamed("text", "item"), item_matched(F.col("text"), F.col("item"))).select("doc_id", "item_id").distinct()
    want = sorted(map(tuple, pairs.collect()), key=repr)
    assert sorted(map(tuple, M.matched_items(docs, items).collect()), key=repr) == want
    several = match(docs.where("text is not null"), "doc_id", "text", items, "item_id", "text", block_bytes=60)
    every = docs.join(items.withColumnRenamed("text", "item"), F.contains("text", F.col("item"))).select("doc_id", "item_id").distinct()
    assert sorted(map(tuple, several.distinct().collect()), key=repr) == sorted(map(tuple, every.collect()), key=repr)
    assert len(want) > 20
    assert M.matched_items(docs.limit(0), items).count() == 0
    assert M.matched_items(docs, items.limit(0)).count() == 0


def test_drain_stops_when_nothing_is_left(spark):
    done: set = set()

    def handle(batch):
        done.update(r.id for r in batch.collect())

    n = I.drain(spark.range(10), "id", handle, 4, lambda rows: rows.where(~F.col("id").isin(sorted(done) or [-1])))
    assert n == 3 and done == set(range(10))


def test_csv_keeps_quoted_breaks(spark):
    text = 'a, b\n1,"x\ny"\n\n2.5\n"say ""hi""",z,extra\n'
    df = spark.createDataFrame([(text,), (None,), ("",), ("1;2",)], "t string")
    got = [r.x for r in df.select(S.csv_objects(F.col("t")).alias("x")).collect()]
    assert got == [['{"a": 1, "b": "x\\ny"}', '{"a": 2.5}', '{"a": "say \\"hi\\"", "b": "z"}'], [], [], []]
    assert df.where("t = '1;2'").select(S.csv_objects(F.col("t"), ";", header=False).alias("x")).first().x == ["[1, 2]"]


def test_expressions_that_are_refused(spark):
    for text in ("a b", "a |", "no_such(a)"):
        with pytest.raises(ValueError):
            J.search(F.lit("{}"), text)
    row = spark.createDataFrame([('{"a": [{"n": 1, "t": "x"}, {"n": 3}, {"n": 5, "t": null}], "b": {"c": 2}}',)], "raw string")
    get = lambda e: row.select(J.search(F.col("raw"), e).alias("v")).first().v
    assert get("a[?n > `2`].n") == "[3,5]" and get("a[*].t") == '["x"]' and get("a[?t == `null`].n | [0]") == "3"
    assert get("[b.c, a | length(@), missing]") == "[2,3,null]" and get("missing[*].x") is None and get("b") == '{"c":2}'


def test_ranks_without_sorting_all(spark, monkeypatch):
    monkeypatch.setattr(M, "_FEW", 50)
    rows = spark.range(1, 2001).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") * 0.5).alias("v")).union(spark.createDataFrame([(None,)], "v double"))
    ordered = sorted(r.v for r in rows.collect() if r.v is not None)
    for rank in (1, 2, 700, 1000, 1999, 2000):
        assert M.value_at(rows, "v", rank) == ordered[rank - 1]
    s = M.summary(rows, "v").first()
    assert (s.median, s.p95, s.p99, s.n) == ((ordered[999] + ordered[1000]) / 2, ordered[1899], ordered[1979], 2000)


def test_session_numbers_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(Gr, "_RANGE", 3)
    s = spark.createDataFrame([(f"u{k}", n, float(k * 7 % 5)) for k in range(9) for n in range(2)], "user string, session int, session_start double")
    got = {(r.user, r.session): r.number for r in Gr.number_sessions(s, "user").collect()}
    order = sorted(got, key=lambda x: (int(x[0][1:]) * 7 % 5, *x))
    assert [got[k] for k in order] == list(range(18))


def test_checksum_of_texts_that_json_escapes(spark):
    text = 'say "hi"\\ \n\ttab \u0001 \u00e9'
    want = hashlib.sha256(json.dumps({"text": text.lower().strip()}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert spark.createDataFrame([(text,)], "t string").select(Ids.embedding_checksum(text=F.col("t"))).first()[0] == want


def test_mined_phrases_hold_together_and_stand_free(spark):
    from kgspark.operators import mining

    rng = np.random.default_rng(5)
    common = [f"w{chr(97 + k)}" for k in range(20)]
    texts = []
    for i in range(120):
        ws = list(rng.choice(common, 12))
        ws[3:3] = ["graph", "store"] if i % 2 else ["deep", "red", "sea"]
        if i % 3 == 0:
            ws[8:8] = ["always", "this"]
            ws[10:10] = ["way"]
        texts.append((i, " ".join(ws).title() if i % 5 == 0 else " ".join(ws)))
    docs = spark.createDataFrame([*texts, (200, None), (201, "graph"), (202, "")], "id int, text string").repartition(3)
    found = {r.phrase: r for r in mining.mined(docs, least=10, cohesion=3.0, freedom=1.0).collect()}
    # Parts of a fixed phrase are always followed or preceded by the same word.
    assert set(found) == {"graph store", "deep red sea", "always this way"}
    assert found["graph store"].n == 60 and found["deep red sea"].cohesion > 3
    got = {r.id: r.phrases for r in mining.phrases_in(docs, "id", spark.createDataFrame(list(found.values()))).collect()}
    assert got[0] == ["deep red sea", "always this way"] and got[1] == ["graph store"] and 200 not in got
    assert mining.mined(docs.where("false")).count() == 0


def test_configurations_of_a_folder(tmp_path):
    from kgspark.sources import config as K

    for name in ("b", "a"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"source": name, "fetchers": [{"name": "f", "unknown": 1}]}))
    found = K.load_all(str(tmp_path))
    assert list(found) == ["a", "b"] and found["b"].source == "b" and found["a"].fetchers[0].name == "f"


def test_drain_fails_where_nothing_shrinks(spark):
    with pytest.raises(RuntimeError, match="5 rows"):
        I.drain(spark.range(5), "id", lambda batch: None, 2, lambda rows: rows)


def test_upserts_with_null_and_equal_times(spark):
    from kgspark.operators import records as Rec

    schema = "_id string, title string, content string, checksum string, version int, synced_at timestamp"
    t = datetime.datetime(2024, 1, 1)
    old = spark.createDataFrame([("a", "old", "c", None, 4, t), ("z", "kept", "c", "sum", 2, t)], schema)
    new = [("a", "u", "c", None, None, None), ("a", "t", "c", None, None, None), ("b", "x", "c", None, None, None), ("c", "p", "c", None, None, t), ("c", "q", "c", None, None, t), ("c", "r", "c", None, None, None)]
    for order in (new, new[::-1]):
        got = {r._id: (r.title, r.version) for r in Rec.upsert(old, spark.createDataFrame(order, schema)).collect()}
        assert got == {"a": ("u", 5), "z": ("kept", 2), "b": ("x", 1), "c": ("q", 1)}


def test_phrases_at_the_threshold(spark):
    """Two neighbours of seven places each are one bit, which reaches a threshold of one bit as it does in SQL."""
    from kgspark.operators import mining

    rows = [(f"{a} enerd enverpfte {a}",) for a in ("x", "y") for _ in range(7)] + [(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}",) for k in range(400)]
    got = mining.mined(spark.createDataFrame(rows, "text string"), longest=2).collect()
    assert [(r.phrase, r.n, r.freedom) for r in got] == [("enerd enverpfte", 14, 1.0)]


def test_ids_are_looked_up_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(G, "TASK_IDS", 100, raising=False)
    nodes = spark.range(1000).select(F.col("id").cast("string").alias("id"))
    edges = spark.range(900).select(F.col("id").cast("string").alias("src"), F.lit("0").alias("dst"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (G.orphan_nodes(nodes, edges), G.without_mentions(nodes, edges.select(F.col("src").alias("rel_id")))):
            assert found.rdd.getNumPartitions() >= 9
            assert sorted(int(r.id) for r in found.collect()) == list(range(900, 1000))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_embedders_get_few_texts_at_a_time(spark):
    rows = spark.range(2300).coalesce(1).select(F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    sizes = C.embed(rows, "text", lambda texts: [np.array([len(texts)], np.float32)] * len(texts)).select(F.col("embedding")[0].alias("n"))
    assert sizes.agg(F.max("n")).first()[0] == 500
    plain = C.hashed_embedder()([r.text for r in rows.collect()])
    assert np.allclose([r.embedding for r in C.embed(rows, "text").collect()], np.array(plain))


def test_json_search_is_spread_over_tasks(spark):
    from kgspark.plans import catalog

    assert catalog.QUERIES["json_search"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1
