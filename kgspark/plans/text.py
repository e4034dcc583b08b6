"""Queries over text functions, markup and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions import ids as I
from kgspark.functions import markup as M
from kgspark.functions import text as T
from kgspark.operators import mining, search
from kgspark.operators.phrases import match
from kgspark.plans.registry import query
from kgspark.plans.tables import read


@query("SELECT p_partkey, regexp_replace(trim(lower('  ' || replace(p_name, ' ', '   ') || ' ')), '\\s+', ' ', 'g') AS name, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS label, p_type || ' - ' || p_name || chr(10) || p_brand AS embedded FROM part")
def normalized_names(spark, sf_dir):
    c = F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("   ")), F.lit(" "))
    return read(spark, sf_dir, "part").select("p_partkey", T.normalize_name(c).alias("name"), T.capitalize_first(F.col("p_name")).alias("label"), T.entity_text(F.col("p_type"), F.col("p_name"), F.col("p_brand")).alias("embedded"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Match' WHEN o_orderkey % 3 = 1 THEN 'a`b' ELSE 'fine_1' END AS name, o_orderkey % 3 <> 2 AS quoted, CASE WHEN o_orderkey % 3 = 0 THEN '`Match`' WHEN o_orderkey % 3 = 1 THEN '`a``b`' ELSE 'fine_1' END AS escaped FROM orders")
def escape_identifiers(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    c = F.when(k == 0, "Match").when(k == 1, "a`b").otherwise("fine_1")
    return read(spark, sf_dir, "orders").select("o_orderkey", c.alias("name"), T.needs_escaping(c).alias("quoted"), T.escape_identifier(c).alias("escaped")).select(
        "o_orderkey", T.unescape_identifier(F.col("escaped")).alias("name"), "quoted", "escaped"
    )


@query(
    """SELECT o_orderkey, '**' || o_orderpriority || '** @U' || o_custkey || ' [site](http://x/' || o_orderkey || ') ~~' || o_orderstatus || '~~ #gen' AS text FROM orders"""
)
def markup_markdown(spark, sf_dir):
    c = F.concat(F.lit("*"), "o_orderpriority", F.lit("* <@U"), F.col("o_custkey").cast("string"), F.lit("> <http://x/"), F.col("o_orderkey").cast("string"), F.lit("|site> ~"), "o_orderstatus", F.lit("~ <#C1|gen>"))
    return read(spark, sf_dir, "orders").select("o_orderkey", M.markup(c).alias("text"))


@query()
def html_markdown(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", M.html_markdown("html").alias("markdown"))


@query("SELECT c_custkey, '**' || c_name || '**[' || c_mktsegment || '](http://x)' AS text FROM customer")
def rich_text_markdown(spark, sf_dir):
    block = lambda text, bold, href: F.struct(
        F.lit("").alias("plain_text"), F.lit(href).cast("string").alias("href"), F.struct(text.alias("content")).alias("text"),
        F.struct(F.lit(bold).alias("bold"), *[F.lit(False).alias(n) for n in ("italic", "code", "strikethrough", "underline")]).alias("annotations"),
    )
    return read(spark, sf_dir, "customer").select("c_custkey", M.rich_text(F.array(block(F.col("c_name"), True, None), block(F.col("c_mktsegment"), False, "http://x"))).alias("text"))


@query("SELECT conv_id, string_agg('[' || CAST(turn AS VARCHAR) || ':' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || '] **' || role || '**: ' || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def transcript_markdown(spark, sf_dir):
    s = F.struct(F.col("turn"), F.struct(F.col("role").alias("speaker"), "text", (F.col("turn") * 60 + F.col("turn") % 60).cast("double").alias("start_time")).alias("s"))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(s)).alias("x")).select("conv_id", M.transcript(F.transform("x", lambda x: x["s"])).alias("text"))


@query("SELECT o_orderkey, CASE WHEN o_custkey = o_orderkey THEN [CAST(o_custkey AS VARCHAR)] ELSE [CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR)] END AS issues, [CAST(o_orderkey AS VARCHAR)] AS pulls, [CAST(o_custkey AS VARCHAR)] AS pages FROM orders")
def cross_references(spark, sf_dir):
    o, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    text = F.concat(F.lit("see #"), c, F.lit(", PR #"), o, F.lit(" and notion.so/"), c, F.lit(" again #"), c)
    rows = read(spark, sf_dir, "orders")
    return rows.select("o_orderkey", T.references(text, T.ISSUE_REFERENCE).alias("issues"), T.references(text, T.PULL_REFERENCE).alias("pulls"), T.references(text, T.PAGE_REFERENCE).alias("pages"))


@query("SELECT DISTINCT n_name, c_custkey FROM (SELECT c_custkey, unnest([c_custkey % 25, c_custkey % 7]) AS r FROM customer) JOIN nation ON n_nationkey = r")
def xref_join(spark, sf_dir):
    """References exploded and joined by equality (C20)."""
    k = F.col("c_custkey")
    text = F.concat(F.lit("#"), (k % 25).cast("string"), F.lit(" #"), (k % 7).cast("string"))
    refs = read(spark, sf_dir, "customer").select("c_custkey", F.explode(T.references(text, T.ISSUE_REFERENCE)).alias("r"))
    return refs.join(read(spark, sf_dir, "nation"), F.col("r") == F.col("n_nationkey").cast("string")).select("n_name", "c_custkey").distinct()


@query("SELECT min(doc_id) AS doc_id, item_id FROM documents d JOIN (SELECT item_id, unnest([string_split(text, ' ')[2], text]) AS p FROM benchmark) ON contains(d.text, p) GROUP BY item_id")
def substring_join(spark, sf_dir):
    """The first document that holds each item's text or its second word."""
    phrases = read(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(F.element_at(F.split("text", " "), 2), "text")).alias("p"))
    return match(read(spark, sf_dir, "documents"), "doc_id", "text", phrases, "item_id", "p").groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT p_partkey, lower('PART') || '' AS kind, 'tpc_part_' || p_partkey AS id, lower(trim(p_brand)) || '|HAS|' || lower(trim(p_type)) AS key, p_brand || ' -[HAS]-> Unknown' AS text FROM part")
def record_keys(spark, sf_dir):
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        F.lower(F.lit("PART")).alias("kind"),
        I.config_entity_id(F.lit("tpc"), F.lit("PART"), F.col("p_partkey").cast("string")).alias("id"),
        I.relationship_key(F.col("p_brand"), F.lit("HAS"), F.col("p_type")).alias("key"),
        T.relationship_text(F.col("p_brand"), F.lit("HAS"), F.lit(None).cast("string"), F.lit("")).alias("text"),
    )


_STOP = "('the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for')"
_CLEAN = "list_filter([trim(lower(x)) for x in {}], lambda x: length(x) > 2 AND x NOT IN " + _STOP + ")"
_FIRSTS = "[x for x, i in {0} if list_position({0}, x) = i]"


@query(
    f"""WITH w AS (SELECT doc_id, [trim(x, '.,;:!?"''()') for x in string_split_regex(text, '\\s+')] AS ws FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, {_CLEAN.format("regexp_extract_all(' ' || array_to_string(ws, ' '), ' (\\p{Lu}[^ ]*(?: \\p{Lu}[^ ]*)*)', 1)")} AS low, {_CLEAN.format("list_filter(ws, lambda x: length(x) > 3)")} AS rest FROM w),
d AS (SELECT doc_id, {_FIRSTS.format("low")} AS low, {_FIRSTS.format("rest")} AS rest FROM l),
u AS (SELECT doc_id, low, rest, list_concat(low, flatten([string_split(x, ' ') for x in low])) AS used FROM d)
SELECT doc_id, low[1:7] AS low_level, list_filter(rest, lambda x: NOT list_contains(used, x))[1:5] AS high_level FROM u"""
)
def keywords(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", search.keywords(F.col("text")).alias("k")).select("doc_id", "k.low_level", "k.high_level")


_MINED = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM documents WHERE text IS NOT NULL),
one AS (SELECT x, count(*) AS c FROM (SELECT unnest(ws) AS x FROM w) GROUP BY x), tot AS (SELECT CAST(sum(c) AS DOUBLE) AS t FROM one),
two AS (SELECT doc_id, i AS pos, ws[i] || ' ' || ws[i + 1] AS phrase, ws[i] AS a, ws[i + 1] AS b, CASE WHEN i > 1 THEN ws[i - 1] ELSE '' END AS bef, coalesce(ws[i + 2], '') AS aft FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w)),
c2 AS (SELECT phrase, a, b, count(*) AS n FROM two GROUP BY ALL HAVING count(*) >= 10),
t2 AS (SELECT phrase, n, log2(n * t / (CAST(x.c AS DOUBLE) * y.c)) AS cohesion FROM c2 JOIN one x ON x.x = a JOIN one y ON y.x = b, tot),
three AS (SELECT doc_id, i AS pos, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS phrase, ws[i] AS a, ws[i + 1] || ' ' || ws[i + 2] AS bc, ws[i] || ' ' || ws[i + 1] AS ab, ws[i + 2] AS c, CASE WHEN i > 1 THEN ws[i - 1] ELSE '' END AS bef, coalesce(ws[i + 3], '') AS aft FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c3 AS (SELECT phrase, a, bc, ab, c, count(*) AS n FROM three GROUP BY ALL HAVING count(*) >= 10),
t3 AS (SELECT c3.phrase, c3.n, least(log2(c3.n * t / (CAST(x.c AS DOUBLE) * y.n)), log2(c3.n * t / (CAST(z.n AS DOUBLE) * v.c))) AS cohesion FROM c3 JOIN one x ON x.x = a JOIN c2 y ON y.phrase = bc JOIN c2 z ON z.phrase = ab JOIN one v ON v.x = c3.c, tot),
tight AS (SELECT * FROM (SELECT * FROM t2 UNION ALL SELECT * FROM t3) WHERE cohesion >= 4),
placed AS (SELECT doc_id, pos, 2 AS k, phrase, bef, aft FROM two UNION ALL SELECT doc_id, pos, 3, phrase, bef, aft FROM three),
near AS (SELECT p.* FROM placed p WHERE phrase IN (SELECT phrase FROM tight)),
hb AS (SELECT phrase, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM (SELECT phrase, bef, count(*) AS c FROM near GROUP BY ALL) GROUP BY phrase),
ha AS (SELECT phrase, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM (SELECT phrase, aft, count(*) AS c FROM near GROUP BY ALL) GROUP BY phrase),
mined AS (SELECT phrase, n, cohesion, least(hb.h, ha.h) AS freedom FROM tight JOIN hb USING (phrase) JOIN ha USING (phrase) WHERE least(hb.h, ha.h) >= 1)
"""


@query(_MINED + "SELECT phrase, n, round(cohesion, 6) AS cohesion, round(freedom, 6) AS freedom FROM mined")
def mined_phrases(spark, sf_dir):
    """Phrases that the texts themselves show, in lower case too."""
    m = mining.mined(read(spark, sf_dir, "documents").where("text is not null"))
    return m.select("phrase", "n", F.round("cohesion", 6).alias("cohesion"), F.round("freedom", 6).alias("freedom"))


@query(
    _MINED
    + ", here AS (SELECT doc_id, phrase, min(pos) AS pos, -k AS k FROM near WHERE phrase IN (SELECT phrase FROM mined) GROUP BY doc_id, phrase, k), found AS (SELECT doc_id, list(phrase ORDER BY pos, k, phrase) AS p FROM here GROUP BY doc_id) SELECT doc_id, p[1:7] AS low_level FROM found"
)
def keywords_mined(spark, sf_dir):
    """Specific keywords of texts by mined phrases, where no tagger is given."""
    d = read(spark, sf_dir, "documents").where("text is not null")
    words = mining.split(d, "doc_id")
    found = mining.phrases_in(d, "doc_id", mining.mined(d, words=words), words=words)
    # The words of the texts are not asked for, so the texts are not joined to their phrases.
    return found.select("doc_id", search.keywords(F.lit(""), lambda _: F.col("phrases")).alias("k")).select("doc_id", "k.low_level")
