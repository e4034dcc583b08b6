"""Operators on small literal tables: nulls, ties, empty inputs and the order-dependent rules."""

import datetime

import pytest
from pyspark.sql import functions as F

from kgspark.operators import chunks as C
from kgspark.operators import graph as G
from kgspark.operators import grouping as P
from kgspark.operators import metrics as M
from kgspark.operators import records as R
from kgspark.operators import search as S
from kgspark.sources import config as K
from kgspark.sources import paged
from kgspark.sources import tables as X
from kgspark.sources import transform as Y
from kgspark.streaming import incremental as I

EDGE = "src string, type string, dst string, confidence double"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_one_hop_counts_a_loop_once(spark):
    e = spark.createDataFrame([("a", "T", "a", 1.0), ("a", "T", "b", 0.5), ("b", "T", "a", None)], EDGE)
    ids = spark.createDataFrame([("a",)], "id string")
    assert G.one_hop(e, ids).count() == 3
    assert G.one_hop(e, ids, "in").count() == 2 and G.one_hop(e, ids, "out", ["X"]).count() == 0


def test_entities_and_relationships(spark):
    e = spark.createDataFrame([(1, "Acme ", "Project", "d1"), (2, "ACME", "Project", "d2"), (3, "acme", "Initiative", "d3"), (4, "B", "X", None), (5, "b", "Y", "d")], "ord int, name string, type string, description string")
    got = {r.key: r for r in G.dedupe_entities(e).collect()}
    assert got["acme"].name == "Acme " and got["acme"].type == "Project" and got["acme"].description == "d1 ||| d2 ||| d3"
    assert got["b"].type == "X"  # a tie goes to the first seen
    many = spark.createDataFrame([(i, "a", "T", f"d{i}") for i in range(10)], e.schema)
    assert G.dedupe_entities(many).first().description.endswith("d5 [...]")
    r = spark.createDataFrame([(1, "A", "B", "T", "x", 7), (2, "a ", " b", "T", "y", 8), (3, "A", "B", "MENTIONED_WITH", "z", 8), (4, "A", "C", "T", "w", 3), (5, "A", "D", "T", "w", 0), (6, "A", "E", "related_to", "w", None)], "ord int, source string, target string, type string, description string, strength int")
    assert [x.ord for x in G.filter_low_value(r).orderBy("ord").collect()] == [1, 2, 5]
    merged = {(x.source, x.target, x.type): x.strength for x in G.merge_relationships(r.where("ord < 3")).collect()}
    assert merged == {("A", "B", "T"): 8}
    empty = r.limit(0)
    assert G.merge_relationships(empty).count() == 0 and G.build_graph(e.withColumns({"doc_ord": F.col("ord"), "pos": F.lit(0)}).limit(0), empty)[1].count() == 0


def test_paths_repeat_no_edge(spark):
    e = spark.createDataFrame([("a", "T", "b", 1.0), ("b", "T", "c", 1.0), ("c", "T", "a", 1.0)], EDGE)
    walks = lambda *a: [",".join(r.nodes) for r in G.paths(e, *a).collect()]
    assert walks("a", "c", 3) == ["a,c", "a,b,c"] and walks("a", "a", 3) == ["a,b,c,a", "a,c,b,a"]
    assert walks("a", "c", 3, 1) == ["a,c"] and walks("a", "z", 3) == []


def test_one_of_equal_keys_is_told_by_its_columns(spark):
    n = spark.createDataFrame([("a", "y", 1), ("a", "x", 2), ("b", "z", 1)], "id string, title string, at int")
    assert rows(G.one_of(n, "id", "at")) == [("a", "x", 2), ("b", "z", 1)]
    assert rows(G.one_of(n, "id", last=False)) == [("a", "x", 2), ("b", "z", 1)]
    assert rows(G.one_of(n, "id")) == [("a", "y", 1), ("b", "z", 1)]


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([("a", "T", "b", 0.5)], EDGE)
    new = spark.createDataFrame([("a", "T", "b", 0.9), ("c", "T", "d", 0.1)], EDGE)
    once = G.upsert_edges(old, new)
    assert rows(once) == rows(G.upsert_edges(once, new)) == [("a", "T", "b", 0.9), ("c", "T", "d", 0.1)]
    n = spark.createDataFrame([("a", "t", "old")], "id string, title string, description string")
    got = G.upsert_nodes(n, spark.createDataFrame([("a", "u", None), ("b", "v", "w")], n.schema))
    assert rows(got) == [("a", "u", "old"), ("b", "v", "w")]


def test_cleanup(spark):
    e = spark.createDataFrame([("a", "T", "b", 1.0), ("b", "T", "c", 1.0)], EDGE)
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    m = spark.createDataFrame([("a", "T", "b", "r1"), ("b", "T", "c", "r1"), ("b", "T", "c", "r2")], "src string, type string, dst string, record_id string")
    gone = spark.createDataFrame([("r1",)], "record_id string")
    for _ in range(2):  # again: nothing more goes
        n, e, m = G.remove_document(n, e, m, gone)
    assert rows(n) == [("b",), ("c",)] and e.count() == 1 and rows(m) == [("b", "T", "c", "r2")]
    assert rows(G.remove_provenance(spark.createDataFrame([("x", ["r1"]), ("y", ["r1", "r2"])], "id string, source_record_ids array<string>"), "r1")) == [("y", ["r2"])]


def test_mentions(spark):
    t = "rel_id string, record_id string, extracted_at int"
    got = G.add_mentions(spark.createDataFrame([("x", "r", 1)], t), spark.createDataFrame([("x", "r", 2), ("x", "s", 1)], t))
    assert rows(got) == [("x", "r", 2), ("x", "s", 1)]


def test_session_gap_is_inclusive(spark):
    t = spark.createDataFrame([(1, "u", 0, "a"), (2, "u", 1800, "a"), (3, "u", 3601, "a"), (4, "u", 3602, "b"), (5, None, 0, "a")], "ord int, user string, s int, ctx string")
    plain = {r.ord: r.session for r in P.user_sessions(t, "user", F.col("s")).collect()}
    assert plain == {1: 0, 2: 0, 3: 1, 4: 1}
    assert {r.ord: r.session for r in P.user_sessions(t, "user", F.col("s"), "ctx").collect()} == {1: 0, 2: 0, 3: 1, 4: 2}


def test_time_windows_are_anchored(spark):
    t = spark.createDataFrame([(1, 0, "a"), (2, 50, "a"), (3, 101, "a"), (4, 110, "b"), (5, 120, "a"), (6, 130, "a")], "ord int, s int, user string").withColumn("page", F.lit(0))
    got = {r.ord: r.group_start for r in P.time_windows(t, F.col("s"), 100, "page", ["user"]).collect()}
    assert got == {1: 0, 2: 0, 3: 101, 4: 110, 5: 120, 6: 120}


def test_threads_and_parents(spark):
    t = spark.createDataFrame([(1, "t1", "1", False), (2, "", "2", True), (3, None, "3", False), (4, "t1", "4", False)], "ord int, thread string, own string, parent boolean")
    got = {r.ord: r.group_id for r in P.thread_groups(t, F.col("thread"), F.col("parent"), F.col("own")).collect()}
    assert got == {1: "t1", 2: "2", 4: "t1"}
    assert {r.ord for r in P.least_size(P.thread_groups(t, F.col("thread")), 3).collect()} == set()
    ids = spark.createDataFrame([(["a", "b"],)], "x array<string>")
    assert [ids.select(P.parent_id(F.col("x"), s)).first()[0] for s in ("first_child", "concatenate")] == ["parent-a", "a-b"]
    with pytest.raises(ValueError):
        P.parent_id(F.col("x"), "nothing")


def test_labelled_batches(spark):
    t = spark.range(95).select(F.col("id").alias("ord"))
    b = P.overlap_batches(t, 50, 10)
    assert {r.batch: r["count"] for r in b.groupBy("batch").count().collect()} == {0: 50, 1: 50, 2: 15}
    got = {r.ord: r.group_id for r in P.labelled_groups(b, lambda rows: [0] * len(rows)).collect()}
    assert got[0] == "0_0" and got[45] == "0_0" and got[60] == "1_0" and len(got) == 95

    def broken(rows):
        raise RuntimeError("no answer")

    assert {r.group_id for r in P.labelled_groups(b, broken).collect()} == {f"single_{i}" for i in range(95)}


def test_chunks(spark):
    def cut(text):
        return [tuple(c) for c in spark.createDataFrame([(text,)], "t string").select(C.chunk(F.col("t"))).first()[0]]

    assert cut("x" * 2000) == [(0, "x" * 2000, 0, 2000)]
    assert cut("") == [(0, "", 0, 0)]
    assert [len(c[1]) for c in cut("x" * 2001)] == [2001]  # a paragraph is not split
    two = cut("a" * 1500 + "\n\n\n" + "b" * 1500)
    assert [(c[2], c[3]) for c in two] == [(0, 1500), (1300, 3001)] and two[1][1] == "a" * 200 + " " + "b" * 1500


def test_index_refresh(spark):
    rec = spark.createDataFrame([("r1", "c2", "T", "new text")], "_id string, checksum string, title string, content string")
    old = C.index_vectors(spark.createDataFrame([], "id string, type string, record_id string, checksum string, chunk_index int, embedding array<float>"), rec.withColumn("checksum", F.lit("c1")))
    assert C.outdated(old, rec).count() == 1
    now = C.index_vectors(old, rec)
    assert [r.checksum for r in now.collect()] == ["c2"] and C.outdated(now, rec).count() == 0


def test_changes_and_upsert(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "z")], "_id string, checksum string")
    b = spark.createDataFrame([("2", "y"), ("3", "old"), ("4", "q")], a.schema)
    assert rows(R.changes(a, b)) == [("1", "new"), ("2", "unchanged"), ("3", "changed")]
    assert ("4", "deleted") in rows(R.changes(a, b, True))
    assert R.changes(a.limit(0), b).count() == 0


def test_modes_drop_what_has_no_edge(spark):
    v = [("chunk", "c", [1.0, 0.0]), ("entity", "e", [1.0, 0.0]), ("relationship", "r", [0.0, 1.0])]
    vec = spark.createDataFrame([(i, t, e, "r1", "e1" if t == "entity" else None, "e1", "e9", "T", 0.4) for i, (t, _, e) in enumerate(v)], "id long, type string, embedding array<float>, record_id string, entity_id string, source_entity_id string, target_entity_id string, rel_type string, confidence double")
    meta = spark.createDataFrame([("e1", ["r1", "r3"])], "entity_id string, source_record_ids array<string>")
    rec = spark.createDataFrame([(f"r{i}", "s", "t", f"T{i}", "text") for i in range(1, 5)], "_id string, source string, record_type string, title string, content string")
    edges = spark.createDataFrame([("r1", "r2", "T", 0.7)], "src string, dst string, type string, confidence double")
    t = S.Tables(vec, meta, rec, edges)
    r = lambda mode, **k: S.Request([1.0, 0.0], [1.0, 0.0], [0.0, 1.0], mode=mode, **k)
    assert [x._id for x in S.retrieve(t, r("naive")).collect()] == ["r1"]
    local = {x._id: x.score for x in S.retrieve(t, r("local")).collect()}
    assert local == {"r1": 1.0, "r2": 0.7}  # r3 has no edge
    assert [x._id for x in S.retrieve(t, r("global")).collect()] == ["r1"]  # the other end is no record
    assert [x._id for x in S.retrieve(t, r("hybrid")).collect()] == ["r1", "r2"]
    assert S.retrieve(t, r("local", top_k=1)).count() == 2
    assert S.retrieve(t, r("naive", threshold=1.1)).count() == 0
    both = S.answer(t, [r("hybrid"), r("mix"), r("naive", threshold=1.1), r("naive")])
    assert sorted((x.query, x._id) for x in both.collect()) == [(0, "r1"), (0, "r2"), (1, "r1"), (1, "r2"), (3, "r1")]
    assert sorted(x.score for x in S.rerank(both.where("query = 0"), None).collect()) == [0.99, 1.0]
    again = S.answer(t, [r("mix", text="T1 zzz"), r("hybrid")], S.overlap_scorer("T1 zzz", ""), 0.3)
    assert sorted((x.query, x._id, x.score) for x in again.collect()) == [(0, "r1", 0.5), (1, "r1", 1.0), (1, "r2", 0.7)]


def test_nearest_keeps_ties_by_id(spark):
    v = [(i, "chunk", e) for i, e in enumerate([[1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [0.0, 0.0], None, [1.0], [0.0, 1.0]])]
    vec = spark.createDataFrame(v, "id long, type string, embedding array<double>").repartition(4)
    assert [x.id for x in S.top_k(vec, [1.0, 0.0], 2, 0.5, "chunk").orderBy("id").collect()] == [0, 1]
    assert {x.id for x in S.top_k(vec, [1.0, 0.0], 9, 0.0, "chunk").collect()} == {0, 1, 2, 6}
    assert S.top_k(vec, [1.0, 0.0], 9, 0.0, "entity").count() == 0 and S.top_k(vec, [0.0, 0.0], 9, -1.0, "chunk").count() == 0


def test_metrics(spark):
    got = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("q", 3, "c"), ("z", 1, "a")], "query string, pos int, id string")
    want = spark.createDataFrame([("q", "a"), ("q", "c"), ("q", "d")], "query string, id string")
    p = {r["query"]: r for r in M.precision_recall(got, want).collect()}
    assert p["q"].precision == pytest.approx(2 / 3) and p["q"].recall == pytest.approx(2 / 3) and p["z"].f1 == 0
    assert M.average_precision(got, want).first().ap == pytest.approx((1 + 2 / 3) / 3)
    assert {r["query"]: r.mrr for r in M.mrr_ndcg(got, want).collect()} == {"q": 1.0, "z": 0.0}
    assert M.matrix_analysis(spark.createDataFrame([("x", "b", 10.0, 5, 1.0), ("x", "f", 5.0, 4, 1.0)], "agent string, setup string, time double, tokens int, cost double"), "b", "f").first().speedup == 2
    log = spark.createDataFrame([(datetime.date(2024, 1, 10), datetime.date(2024, 1, 20))], "start date, end date")
    assert M.next_range(log, 5).first().start == datetime.date(2024, 1, 5)


def test_config():
    c = K.from_dict({"source": "s", "fetchers": [{"name": "b", "depends_on": ["a"], "record_type": "r"}, {"name": "a"}, {"name": "w", "tool_class": "write"}, {"name": "u", "depends_on": ["nothing"]}], "record_types": [{"name": "r", "id_field": "id"}, {"name": "lost"}], "sync_order": ["a"]})
    assert [f.name for f in K.ordered_fetchers(c)] == ["a", "b", "u"]
    assert K.levels(c.fetchers) == {"a": 0, "b": 1, "w": 0, "u": 999}
    assert set(K.problems(c)) == {("MISSING_FETCHER", "nothing"), ("ORPHAN_RECORD_TYPE", "lost"), ("MISSING_ID_FIELD", "lost")}
    assert [f.name for f in K.repaired(c).fetchers] == ["b", "a"]


def client(seed, cursor, size):
    """Three pages of a seed; the last one is old."""
    page = cursor or 0
    rows = [f'{{"seed": "{seed}", "n": {page * size + i}, "date": "2024-01-0{3 - page}"}}' for i in range(size)]
    return rows, page + 1 if page < 2 else None


def test_paged_source(spark):
    spark.dataSource.register(paged.PagedSource)
    read = spark.read.format("paged").option("client", "tests.test_operators:client").option("seeds", '["x", "y"]').option("page_size", "2")
    assert read.load().count() == 12
    assert read.option("since", "2024-01-02").load().groupBy("seed").count().collect()[0]["count"] == 4


def test_calls_are_tried_again():
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("busy")
        return "done"

    assert paged.call(flaky, sleep=lambda s: None) == "done" and len(tries) == 3
    with pytest.raises(paged.SourceError):
        paged.call(lambda: (_ for _ in ()).throw(paged.SourceError("no")), sleep=lambda s: None)


def test_tables(spark, tmp_path):
    t = spark.createDataFrame([(i, "ann" if i % 2 else "bob", "open", ["bug"], f"Title {i}", None, i, i) for i in range(10)], "id int, author string, state string, labels array<string>, title string, body string, created_at int, updated_at int")
    assert [r.id for r in X.search_pulls(t, "author:ann", size=2).collect()] == [9, 7]
    assert X.search_pulls(t, "label:bug").first().total == 10 and X.search_pulls(t, "title 3").count() == 1
    assert [r.id for r in X.keyset_page(t, "id", 3, 2).collect()] == [4, 5]
    X.write_csv(t.select("id", F.lit('a"b,c').alias("x")), f"{tmp_path}/csv")
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").first().x == 'a"b,c'
    (tmp_path / "q.json").write_text('[{"workflow": {"groupId": "g"}, "testCases": [{"query": "q", "evaluationCriteria": {"mustInclude": ["a", "b"]}}]}]')
    assert tuple(X.judged_queries(spark, f"{tmp_path}/q.json").first()) == ("g", 0, "q", ["a", "b"])


def test_source_ids(spark):
    cases = [('{"id": "1"}', "1"), ('{"uuid": "u"}', "u"), ('{"x": 1, "user_id": "7"}', "7"), ('{"url": "http://x"}', "http://x"), ('{"id": ""}', None), ("{}", None)]
    t = spark.createDataFrame([(r,) for r, _ in cases], "raw string")
    assert [r[0] for r in t.select(Y.source_id(F.col("raw"))).collect()] == [w for _, w in cases]
    assert Y.unwrap(spark.createDataFrame([(1, '{"data": [1, 2]}'), (2, "[3]"), (3, '{"a": 4}')], "ord int, raw string")).count() == 4


def test_micro_batches_upsert_once(spark, tmp_path):
    schema = "_id string, title string, content string, checksum string, version int, synced_at timestamp"
    now = datetime.datetime(2024, 1, 1)
    for n, rows_ in enumerate([[("1", "a", "x")], [("1", "b", "y"), ("2", "c", "z")]]):
        spark.createDataFrame([(i, t, c, None, 1, now) for i, t, c in rows_], schema).write.mode("append").parquet(f"{tmp_path}/in")
        q = I.micro_batches(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), I.upsert_into(spark, f"{tmp_path}/out", spark.createDataFrame([], schema).schema), f"{tmp_path}/c")
        q.awaitTermination()
        assert n < 2
    assert rows(I.table_of(spark, f"{tmp_path}/out", spark.createDataFrame([], schema).schema).select("_id", "title", "version")) == [("1", "b", 2), ("2", "c", 1)]
    assert I.next_status(True, 2) == ("error", 3) and I.next_status(False, 2) == ("idle", 0)
