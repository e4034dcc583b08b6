"""Queries over sources and sinks: paged reads, files, parameters of nested calls, formats, bounded batches."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from kgspark.functions import json as J
from kgspark.functions import markup as M
from kgspark.plans.ingest import raw
from kgspark.plans.registry import query
from kgspark.plans.tables import read
from kgspark.session import shared_folder, written
from kgspark.sources import config as C
from kgspark.sources import discovery as D
from kgspark.sources import tables as S
from kgspark.sources import transform as X
from kgspark.sources.paged import PagedSource, call_each
from kgspark.streaming import incremental as I


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("SELECT 'nation' AS seed, n_nationkey AS key, CAST(n_nationkey // 7 AS INT) AS page FROM nation UNION ALL SELECT 'region', r_regionkey, 0 FROM region")
def paged_read(spark, sf_dir):
    """Two starting values read page by page through the paged source."""
    spark.dataSource.register(PagedSource)
    seeds = json.dumps([{"path": f"{sf_dir}/{t}.parquet", "key": k} for t, k in (("nation", "n_nationkey"), ("region", "r_regionkey"))])
    rows = spark.read.format("paged").option("client", "kgspark.sources.paged:parquet_pages").option("seeds", seeds).option("page_size", "7").load()
    key = F.coalesce(J.value(F.col("raw"), "n_nationkey"), J.value(F.col("raw"), "r_regionkey")).cast("long")
    return rows.select(F.when(F.contains("seed", F.lit("nation.parquet")), "nation").otherwise("region").alias("seed"), key.alias("key"), "page")


@query("SELECT 'customer' AS seed, c_custkey AS key, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 40 AS INT) AS page FROM customer UNION ALL SELECT 'supplier', s_suppkey, CAST((row_number() OVER (ORDER BY s_suppkey) - 1) // 40 AS INT) FROM supplier")
def stream_pages(spark, sf_dir):
    """Pages of two starting values as a stream that stops halfway and goes on from its checkpoint (K1, K3)."""
    spark.dataSource.register(PagedSource)
    folder = _folder(spark)
    seeds = json.dumps([{"path": f"{sf_dir}/{t}.parquet", "table": t} for t in ("customer", "supplier")])
    source = spark.readStream.format("paged").option("client", "kgspark.sources.paged:parquet_pages").option("seeds", seeds).option("page_size", "40")
    half = read(spark, sf_dir, "customer").count() // 80 * 40
    for stream in (source.option("until", str(half)).load(), source.option("until", str(1 << 60)).load()):
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    key = F.coalesce(J.value(F.col("raw"), "c_custkey"), J.value(F.col("raw"), "s_suppkey")).cast("long")
    return spark.read.parquet(f"{folder}/out").select(J.value(F.col("seed"), "table").alias("seed"), key.alias("key"), "page")


@query(
    """SELECT n_nationkey, CASE WHEN n_nationkey % 7 <> 3 THEN c_custkey END AS c_custkey, CASE WHEN n_nationkey % 7 <> 3 THEN CAST((row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) - 1) // 5 AS INT) ELSE 0 END AS page, n_nationkey % 7 = 3 AS failed
FROM nation JOIN customer ON n_nationkey % 7 <> 3 AND c_nationkey = n_nationkey UNION ALL SELECT n_nationkey, NULL, 0, true FROM nation WHERE n_nationkey % 7 = 3"""
)
def item_calls(spark, sf_dir):
    """A call for each row of an earlier result, page by page, under a limit of calls; some fail and the others go on."""
    n, path = F.col("n_nationkey"), f"{sf_dir}/customer.parquet"
    # A call for a file that is not there fails.
    file = F.when(n % 7 == 3, F.lit(f"{sf_dir}/no_such.parquet")).otherwise(F.lit(path))
    items = read(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct(file.alias("path"), F.lit("c_nationkey").alias("column"), n.alias("value"), F.array(F.lit("c_custkey")).alias("columns"))).alias("params"))
    rows = call_each(items, "params", "kgspark.sources.paged:parquet_matches", page_size=5, concurrency=4, limit=4000, window=1.0, retries=0)
    return rows.select("n_nationkey", J.value(F.col("raw"), "c_custkey").cast("long").alias("c_custkey"), "page", F.col("error").isNotNull().alias("failed"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def seeded_rows(spark, sf_dir):
    """Rows of a source for each seed that earlier rows gave."""
    seeds = read(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return S.for_each(seeds, read(spark, sf_dir, "customer"), "c_nationkey").select("c_custkey", "c_nationkey")


@query("SELECT DISTINCT c_name AS seed FROM customer WHERE c_custkey % 3 = 0")
def starting_points(spark, sf_dir):
    """Starting values that a discovery answer holds under a path."""
    return D.seeds(None, raw(spark, sf_dir), "info.name", "kind == 'vip'")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def json_round_trip(spark, sf_dir):
    """A JSON data set written and loaded."""
    path = _folder(spark)
    read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).write.json(path)
    return spark.read.schema("id long, name string").json(path)


@query("SELECT p_partkey AS id, 'say \"' || p_name || '\", twice' AS text FROM part")
def csv_report(spark, sf_dir):
    """A report with quotes and commas, written and read back."""
    path = _folder(spark)
    S.write_csv(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit('say "'), F.col("p_name"), F.lit('", twice')).alias("text")), path)
    return spark.read.option("header", True).option("escape", '"').schema("id long, text string").csv(path)


@query("SELECT 'w' || r_regionkey AS workflow, CAST(0 AS INT) AS n, r_name AS query, [lower(r_name), 'x'] AS must_include FROM region WHERE r_regionkey <> 2")
def evaluation_queries(spark, sf_dir):
    """Test cases of an evaluation file, skipped workflows left out."""
    path = _folder(spark)
    name = F.col("r_name")
    cases = F.array(F.struct(name.alias("query"), F.struct(F.array(F.lower(name), F.lit("x")).alias("mustInclude")).alias("evaluationCriteria")))
    rows = read(spark, sf_dir, "region").agg(F.to_json(F.collect_list(F.struct(F.struct(F.concat(F.lit("w"), F.col("r_regionkey").cast("string")).alias("groupId")).alias("workflow"), cases.alias("testCases")))).alias("value"))
    rows.write.text(path)
    return S.judged_queries(spark, path, spark.createDataFrame([("w2",)], "workflow string"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-03-31'")
def dated_rows(spark, sf_dir):
    """Rows of an inclusive range of dates."""
    lit = lambda d: F.lit(d).cast("timestamp")
    return S.between(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", lit("1995-01-01"), lit("1995-03-31"))


@query("SELECT n_nationkey, '# ' || n_name || chr(10) || chr(10) || '- [x] do ' || n_name || chr(10) || chr(10) || '---' AS text FROM nation")
def blocks_markdown(spark, sf_dir):
    """Content blocks to Markdown."""
    name = F.col("n_name")
    said = lambda t: F.array(F.struct(t.alias("plain_text")))
    blocks = F.concat(
        F.lit('[{"type":"heading_1","heading_1":{"rich_text":'), F.to_json(said(name)), F.lit('}},{"type":"to_do","to_do":{"checked":true,"rich_text":'),
        F.to_json(said(F.concat(F.lit("do "), name))), F.lit('}},{"type":"divider","divider":{}}]'),
    )
    return read(spark, sf_dir, "nation").select("n_nationkey", M.blocks_markdown(blocks).alias("text"))


@query("SELECT n_nationkey, upper(n_name) AS text FROM nation")
def processor_mapping(spark, sf_dir):
    """A field by a processor that a caller registered."""
    M.register_processor("upper", F.upper)
    rows = read(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"))).alias("raw"))
    return rows.select("n_nationkey", X.field(F.col("raw"), {"type": "processor", "processor": "upper", "path": "name"}).alias("text"))


@query("""SELECT n_nationkey, '{"a":{"x":' || n_nationkey || ',"y":2},"l":[1,2],"z":"' || n_name || '"}' AS merged FROM nation""")
def merged_json(spark, sf_dir):
    """Objects merged key by key, lists joined."""
    k = F.col("n_nationkey").cast("string")
    one = F.concat(F.lit('{"a": {"x": '), k, F.lit('}, "l": [1], "z": "old"}'))
    two = F.concat(F.lit('{"a": {"y": 2}, "l": [2], "z": "'), F.col("n_name"), F.lit('"}'))
    return read(spark, sf_dir, "nation").select("n_nationkey", F.regexp_replace(D.merge_json(one, two), "(?<=[:,]) ", "").alias("merged"))


@query("""SELECT c_custkey AS ord, '"' || c_name || '"' AS name, '["a","' || lower(c_mktsegment) || '"]' AS tags, '"' || lower(c_mktsegment) || '"' AS last, '2' AS n, CASE WHEN lower(c_mktsegment) = 'a' THEN '["a","a"]' ELSE '["a"]' END AS only_a,
'{"id":' || c_custkey || ',"none":null,"who":"' || c_name || '"}' AS picked, CASE WHEN c_custkey > 10 THEN 'true' ELSE 'false' END AS large, '["' || upper(c_name) || '",2]' AS listed, '["' || lower(c_mktsegment) || '"]' AS others, '["a"]' AS cut,
CASE WHEN c_custkey % 2 = 0 THEN '"even"' ELSE '"' || c_name || '"' END AS either, '{"tags":["a","' || lower(c_mktsegment) || '"]}' AS nested FROM customer""")
def json_search(spark, sf_dir):
    """Expressions over JSON: projections, filters, slices, comparisons, choices, functions, lists and objects."""
    r = F.col("raw")
    # A file of a few megabytes is one task's; its expressions are work for all.
    rows = raw(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism, "ord")
    upper = F.regexp_replace(r, '"name":"[^"]*"', F.concat(F.lit('"name":"'), F.upper(J.value(r, "info.name")), F.lit('"')))
    even = F.concat(F.lit('{"even": '), F.when(J.value(r, "cust_id").cast("long") % 2 == 0, '"even"').otherwise("null"), F.lit(', "name": "'), J.value(r, "info.name"), F.lit('"}'))
    return rows.select(
        "ord", J.search(r, "info.name").alias("name"), J.search(r, "info.tags[*].tag").alias("tags"), J.search(r, "info.tags[].tag | [-1]").alias("last"), J.search(r, "info.tags | length(@)").alias("n"),
        J.search(r, "info.tags[?tag == 'a'].tag").alias("only_a"), J.transform(r, {"who": "info.name", "id": "cust_id", "none": "nothing.here"}).alias("picked"), J.search(r, "cust_id > `10`").alias("large"), J.search(upper, "info.[name, length(tags)]").alias("listed"),
        J.search(r, "info.tags[1:].tag").alias("others"), J.search(r, "info.tags[::-1] | [-1:].tag").alias("cut"), J.search(even, "even || name").alias("either"), J.search(r, "{tags: info.tags[*].tag}").alias("nested"),
    )


@query("""SELECT c_custkey AS ord, '{"limit":10,"name":"' || c_name || '","owner":"me","gone":null}' AS params FROM customer""")
def nested_parameters(spark, sf_dir):
    """Parameters of a call that a parent record decides."""
    return raw(spark, sf_dir).select("ord", J.parameters(F.col("raw"), {"limit": 10}, {"name": "$parent.info.name", "owner": "me", "gone": "$parent.info.gone.x"}).alias("params"))


@query("""SELECT o_orderkey, '{"id": ' || o_orderkey || ', "note": "two' || chr(92) || 'nlines, one", "w": ' || o_custkey || '.5}' AS line FROM orders UNION ALL SELECT o_orderkey, '{"id": 7, "note": "y"}' FROM orders""")
def csv_objects(spark, sf_dir):
    """CSV with quoted line breaks, numbers and ragged lines as JSON objects."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    text = F.concat(F.lit("id, note ,w\n"), k, F.lit(',"two\nlines, one",'), c, F.lit(".5\n\n7,y\n"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.explode(S.csv_objects(text)).alias("line"))


@query("SELECT CAST(sum(CASE WHEN true THEN 1 END) AS BIGINT) AS rows, true AS bounded FROM orders")
def bounded_flushes(spark, sf_dir):
    """Rows handed to a writer in flushes of at most 100 (K2)."""
    f = I.flushes(read(spark, sf_dir, "orders").select("o_orderkey"), lambda rows: None, 100)
    return f.agg(F.sum("n").alias("rows"), (F.max("n") <= 100).alias("bounded"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS _id, CAST(max(o_orderkey) AS VARCHAR) AS title, CAST(1 AS INT) AS version FROM orders GROUP BY 1")
def stream_upserts(spark, sf_dir):
    """A stream of records upserted into buckets, the latest of each id."""
    folder = _folder(spark)
    schema = "_id string, title string, content string, checksum string, version int, synced_at timestamp"
    o = read(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").cast("string").alias("_id"), F.col("o_orderkey").cast("string").alias("title"), F.lit("").alias("content"), F.lit(None).cast("string").alias("checksum"), F.lit(1).alias("version"), F.timestamp_seconds("o_orderkey").alias("synced_at"))
    rows.write.parquet(f"{folder}/in")
    types = spark.createDataFrame([], schema).schema
    I.micro_batches(spark.readStream.schema(types).parquet(f"{folder}/in"), I.upsert_into(spark, f"{folder}/out", types, 8), f"{folder}/checkpoint").awaitTermination()
    return I.table_of(spark, f"{folder}/out", types).select("_id", "title", "version")


@query(
    """SELECT 'MCP_TOOL_ERROR' AS code, 'broken' AS fetcher, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'EMPTY_RESULTS', 'suppliers', 1 UNION ALL SELECT 'DETECTION_CONDITION_FAILED', 'suppliers', 3
UNION ALL SELECT 'DETECTION_CONDITION_FAILED', 'customers', n FROM (SELECT count(*) AS n FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 3) WHERE c_custkey % 2 <> 0) WHERE n > 0
UNION ALL SELECT 'NO_MATCHING_RECORD_TYPE', 'untyped', 1 UNION ALL SELECT 'ORPHAN_RECORD_TYPE', 'gone', 1 UNION ALL SELECT 'MISSING_FETCHER', 'gone', 1
UNION ALL SELECT 'total', 'customers', least(count(*), 50) FROM customer UNION ALL SELECT 'matched', 'customers', count(*) FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 50) WHERE c_custkey % 2 = 0
UNION ALL SELECT 'total', 'suppliers', least(count(*), 50) FROM supplier UNION ALL SELECT 'matched', 'suppliers', 0"""
)
def config_first_pages(spark, sf_dir):
    """The first page of each fetcher, what of it has a type, and all kinds of faults."""
    folder = _folder(spark)
    even = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "vip").alias("kind"))
    even.repartitionByRange(1, "c_custkey").sortWithinPartitions("c_custkey").write.parquet(f"{folder}/customers")
    part = [p for p in spark.read.parquet(f"{folder}/customers").inputFiles() if p.endswith(".parquet")][0].removeprefix("file://")
    config = C.from_dict(
        {
            "source": "s",
            "fetchers": [{"name": n} for n in ("customers", "suppliers", "broken", "untyped")] + [{"name": "drop", "tool_class": "write"}],
            "record_types": [
                {"name": "vip", "fetcher": "customers", "condition": "record.kind === 'vip'", "id_field": "c_custkey"},
                {"name": "never", "fetcher": "suppliers", "condition": "record.no_such", "id_field": "s_suppkey"},
                {"name": "failing", "fetcher": "broken", "condition": "always"},
                {"name": "lost", "fetcher": "gone", "condition": "always"},
            ],
        }
    )
    paths = {"customers": part, "suppliers": f"{sf_dir}/supplier.parquet", "broken": f"{sf_dir}/no_such.parquet", "untyped": f"{sf_dir}/nation.parquet"}
    pages = D.first_pages(config, spark, {k: {"path": p} for k, p in paths.items()}, "kgspark.sources.paged:parquet_pages", page_size=50, concurrency=4, retries=0)
    stats, faults = D.dry_run_report(written(pages), config)
    counts = stats.select(F.explode(F.array(F.struct(F.lit("total").alias("code"), F.col("total").alias("n")), F.struct(F.lit("matched").alias("code"), F.col("matched").alias("n")))).alias("x"), "fetcher").select("x.code", "fetcher", "x.n")
    return faults.groupBy("code", "fetcher").agg(F.count("*").alias("n")).unionByName(counts)


@query("SELECT c_custkey AS ord, 's_customer_' || c_custkey AS id, '2024-01-0' || (1 + c_custkey % 9) || ' 00:00:00' AS day, c_name || ' (' || c_mktsegment || ')' AS rich, CAST(length(c_name) AS VARCHAR) AS n, '[' || chr(34) || c_name || chr(34) || ']' AS picked FROM customer")
def mapping_helpers(spark, sf_dir):
    """Fields by helpers and expressions, as configurations name them."""
    c = read(spark, sf_dir, "customer")
    rich = F.array(F.struct(F.col("c_name").alias("plain_text")), F.struct(F.concat(F.lit(" ("), F.col("c_mktsegment"), F.lit(")")).alias("plain_text")))
    rows = c.select(F.col("c_custkey").alias("ord"), F.to_json(F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), rich.alias("rich"), F.concat(F.lit("2024-01-0"), 1 + F.col("c_custkey") % 9).alias("day"))).alias("raw"))
    r = F.col("raw")
    return rows.select(
        "ord", X.field(r, {"type": "helper", "helper": "generateId", "source": "s", "record_type": "customer", "path": "key"}).alias("id"), X.field(r, {"type": "helper", "helper": "formatDate", "path": "day"}).alias("day"),
        X.field(r, {"type": "helper", "helper": "extractRichText", "path": "rich"}).alias("rich"), X.field(r, {"type": "expression", "expression": "length(name)"}).alias("n"), X.field(r, {"type": "expression", "expression": "[name]"}).alias("picked"),
    )


@query(
    """SELECT n_nationkey AS ord, '7' AS s, '7' AS d, n_name AS field, CASE WHEN n_nationkey % 2 = 0 THEN n_name || chr(10) || 'x' ELSE '{"z":' || n_nationkey || '}' END AS lines FROM nation"""
)
def extracted_texts(spark, sf_dir):
    """Texts of JSON strings, objects, lists and anything else."""
    n, k = F.col("n_name"), F.col("n_nationkey").cast("string")
    lines = F.when(F.col("n_nationkey") % 2 == 0, F.to_json(F.array(F.struct(n.alias("text")), F.struct(F.lit("x").alias("text"))))).otherwise(F.concat(F.lit('{"z":'), k, F.lit("}")))
    t = read(spark, sf_dir, "nation")
    return t.select(F.col("n_nationkey").alias("ord"), M.extract_text(F.lit('"7"')).alias("s"), M.extract_text(F.lit("7")).alias("d"), M.extract_text(F.to_json(F.struct(n.alias("text")))).alias("field"), M.extract_text(lines).alias("lines"))


@query(
    """SELECT name, CAST(position AS INT) AS position, CAST(level AS INT) AS level, n FROM (VALUES ('c', 0, 2), ('a', 1, 0), ('b', 2, 1), ('s', 3, 0), ('u', 4, 999)) AS t(name, position, level)
JOIN (SELECT count(*) AS n FROM nation) ON true"""
)
def fetcher_order(spark, sf_dir):
    """A configuration written as files and loaded, its fetchers in order, without write tools and unneeded searches, and how deep their inputs go."""
    folder = _folder(spark)
    parts = [{"name": "a"}, {"name": "b", "depends_on": ["a", "s"]}, {"name": "c", "depends_on": ["b"]}, {"name": "w", "tool_class": "write"}, {"name": "s", "tool_class": "search"}, {"name": "t", "tool_class": "search"}, {"name": "u", "depends_on": ["nowhere"]}]
    rows = read(spark, sf_dir, "nation").agg(F.count("*").alias("n")).select(F.to_json(F.struct(F.lit("src").alias("source"), F.col("n"), F.lit(json.dumps(parts)).alias("fetchers"), F.lit(json.dumps(["c", "a"])).alias("sync_order"))).alias("value"))
    rows.coalesce(1).write.text(f"{folder}/config")
    loaded = json.loads(spark.read.text(f"{folder}/config", wholetext=True).first()[0])
    config = C.from_dict({**loaded, "fetchers": json.loads(loaded["fetchers"]), "sync_order": json.loads(loaded["sync_order"])})
    depth = C.levels(config.fetchers)
    return spark.createDataFrame([(f.name, i, depth[f.name], loaded["n"]) for i, f in enumerate(C.ordered_fetchers(config))], "name string, position int, level int, n long")


@query("SELECT c_custkey AS ord, 'info.tags' AS paths, CAST(2 AS INT) AS ids, CASE WHEN c_custkey % 5 <> 0 THEN 'id' ELSE 'cust_id' END AS first FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, 'info.tags', 1, 'cust_id' FROM customer WHERE c_custkey % 5 = 0")
def answer_shapes(spark, sf_dir):
    """Lists of objects and id-like fields in answers."""
    r = raw(spark, sf_dir)
    found = r.withColumn("f", D.discover_ids("raw"))
    return found.select("ord", F.array_join(D.array_paths_of("raw"), ",").alias("paths"), F.size("f").alias("ids"), F.col("f")[0]["path"].alias("first"))
