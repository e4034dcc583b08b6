"""Document fingerprints: a Merkle tree over sections, paragraphs and sentence-like pieces.

A branch is written as a string: its digest, then what lies below it. Roots test equality; two texts are compared by
descending only into the branches whose digests differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm._shared import first_bound

#: Leaves end after sentence marks, or after so many code points without one.
LEAF = "[^.!?]{1,96}[.!?]*|[.!?]+"
#: Documents of one block, whose neighbours in doc_id order are found together; and the most blocks, whose bounds a plan
#: holds. At 25 billion documents a block is 1.5 GB, which the sort spills as it must.
BLOCK_ROWS, MAX_BLOCKS = 2000, 1 << 16
#: Hexadecimal digits of a leaf's digest and of a branch's.
LEAF_DIGITS, DIGITS = 32, 64


def tree(text: Column) -> Column:
    """Sections: each its digest, then for each paragraph a mark and the paragraph's digest and leaf digests.

    Joining back the parts gives the text, so equal trees mean equal texts. A section's digest is that of its
    paragraphs' digests, a paragraph's that of its leaves'.
    """

    def paragraph(p: Column) -> Column:
        leaves = F.array_join(F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda leaf: F.substring(F.sha2(leaf, 256), 1, LEAF_DIGITS)), "")
        return _let(leaves, lambda x: F.concat(F.sha2(x, 256), x))

    def section(s: Column) -> Column:
        return F.transform(F.split(s, "\n"), paragraph)

    return F.transform(F.transform(F.split(text, "\n\n"), section), lambda ps: F.concat(F.sha2(F.array_join(digests(ps), ""), 256), F.array_join(F.transform(ps, lambda p: F.concat(F.lit("|"), p)), "")))


def digests(branches: Column) -> Column:
    return F.transform(branches, lambda x: F.substring(x, 1, DIGITS))


def root(t: Column) -> Column:
    return F.sha2(F.array_join(digests(t), ""), 256)


def paragraphs(section: Column) -> Column:
    """Of a section: paragraphs with their digests."""
    return F.split(F.substr(section, F.lit(DIGITS + 2)), "\\|")


def leaves(paragraph: Column) -> Column:
    """Of a paragraph: its leaves' digests, or one empty text where it has none."""
    found = F.regexp_extract_all(F.substr(paragraph, F.lit(DIGITS + 1)), F.lit("[0-9a-f]{%d}" % LEAF_DIGITS), F.lit(0))
    return _let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(""))))


def _size(branches: Column) -> Column:
    """Leaves below paragraphs; one without leaves counts as one."""
    return F.aggregate(branches, F.lit(0).cast("long"), lambda n, p: n + F.greatest(F.floor((F.length(p) - DIGITS) / LEAF_DIGITS), F.lit(1).cast("long")))


#: How much of likeness comes from the branches in common; the rest comes from their places.
COMMON = 0.9


def _in_place(a: Column, b: Column) -> Column:
    """Share of two lists of digests that stands equal at their beginnings and ends; 1 only for equal lists."""
    least, most = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    begin, end = (F.coalesce(first_difference(x, y), least) for x, y in ((a, b), (F.reverse(a), F.reverse(b))))
    return F.least(begin + end, least) / most


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two trees (0 to 1; 1 only for equal trees).

    Nine tenths are the share of leaves that they have in common, times the smaller number of leaves over the larger.
    Equal sections count with all their leaves; in the others, equal paragraphs do; and only the leaves of the rest are
    compared one by one; a repeated branch counts once in the share, but always in the numbers. One tenth is the share
    of sections and of paragraphs that stand in the same places, from the beginning or the end.
    """
    below = lambda sections: F.flatten(F.transform(sections, paragraphs))
    same = _size(below(F.array_intersect(a, b)))
    state = F.struct(same.alias("same"), below(F.array_except(a, b)).alias("p"), below(F.array_except(b, a)).alias("q"))
    state = _let(state, lambda s: F.struct((s["same"] + _size(F.array_intersect(s["p"], s["q"]))).alias("same"), F.array_except(s["p"], s["q"]).alias("p"), F.array_except(s["q"], s["p"]).alias("q")))
    state = _let(state, lambda s: F.struct(s["same"].alias("same"), F.array_distinct(F.flatten(F.transform(s["p"], leaves))).alias("p"), F.array_distinct(F.flatten(F.transform(s["q"], leaves))).alias("q")))
    share = _let(state, lambda s: 2.0 * (s["same"] + F.size(F.array_intersect(s["p"], s["q"]))) / (2 * s["same"] + F.size(s["p"]) + F.size(s["q"])))

    def whole(s: Column) -> Column:
        n, m = _size(s["p"]), _size(s["q"])
        places = (_in_place(s["a"], s["b"]) + _in_place(digests(s["p"]), digests(s["q"]))) / 2
        return COMMON * s["share"] * F.least(n, m) / F.greatest(n, m) + (1 - COMMON) * places

    parts = F.struct(digests(a).alias("a"), digests(b).alias("b"), below(a).alias("p"), below(b).alias("q"), share.alias("share"))
    return F.when(digests(a) == digests(b), 1.0).otherwise(_let(parts, whole))


def _let(value: Column, then) -> Column:
    """``then(value)``, evaluating ``value`` once."""
    return F.transform(F.array(value), then)[0]


def first_difference(a: Column, b: Column) -> Column:
    """Where two lists first differ, counted from 0; null if they are equal."""
    return F.when(a == b, None).otherwise(F.coalesce(F.nullif(F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False), F.lit(0)), F.lit(0)) - 1).cast("long")


def first_edit(a: Column, b: Column) -> Column:
    """Section, paragraph in it and leaf in that (from 0) where two trees first differ, found from the top; nulls if equal."""
    none = F.array(F.lit(""))
    at = lambda x, i: F.coalesce(F.get(x, i.cast("int")), F.lit("|"))

    def within(s: Column) -> Column:
        i = first_difference(digests(s["a"]), digests(s["b"]))
        return _let(F.struct(i.alias("i"), paragraphs(at(s["a"], i)).alias("p"), paragraphs(at(s["b"], i)).alias("q")), paragraph)

    def paragraph(s: Column) -> Column:
        j = first_difference(digests(s["p"]), digests(s["q"]))
        return _let(F.struct(s["i"].alias("i"), j.alias("j"), leaves(at(s["p"], j)).alias("l"), leaves(at(s["q"], j)).alias("m")), leaf)

    def leaf(s: Column) -> Column:
        return F.struct(s["i"].alias("section"), s["j"].alias("paragraph"), first_difference(s["l"], s["m"]).alias("leaf"))

    nothing = F.lit(None).cast("struct<section:bigint,paragraph:bigint,leaf:bigint>")
    return F.when(digests(F.coalesce(a, none)) == digests(F.coalesce(b, none)), nothing).otherwise(_let(F.struct(a.alias("a"), b.alias("b")), within))


def with_next(docs: DataFrame, value: str) -> DataFrame:
    """Add next_``value``: that of the next row in descending doc_id order; after the last row comes the first.

    Rows are dealt to blocks by sampled boundaries that are doc_ids themselves, so a block ends with a row that is
    known: each boundary row is also sent to the block above it, and the largest to the lowest block. A null doc_id
    orders below all others. Rows of equal doc_id are ordered by their value.
    """
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = docs.withColumn("_id", order)
    n = rows.count()
    blocks = min(MAX_BLOCKS, max(1, n // BLOCK_ROWS))
    cuts = rows.agg(F.percentile_approx("_id", [(k + 1) / blocks for k in range(blocks - 1)] or [1.0], max(10_000, 4 * blocks)), F.max("_id"), F.min("_id")).first()
    if cuts[1] is None:
        return docs.withColumn(f"next_{value}", F.col(value))
    bounds = sorted({*cuts[0], cuts[1]})
    own = F.col("_block")
    bound = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    above = F.when(F.col("_id") == F.element_at(bound, own + 1), F.when(own + 1 < len(bounds), own + 1).otherwise(0))
    sent = F.array_compact(F.array(F.struct(own.alias("at"), F.lit(0).alias("guest")), F.when(above.isNotNull(), F.struct(above.alias("at"), F.lit(1).alias("guest")))))
    dealt = rows.withColumn("_block", first_bound(F.col("_id"), bounds)).withColumn("_sent", F.explode(sent))
    w = Window.partitionBy("_sent.at").orderBy(F.col("_sent.guest"), F.col("_id").desc(), F.col(value).desc())
    found = dealt.withColumn(f"next_{value}", F.lead(value).over(w))
    return found.where("_sent.guest = 0").drop("_id", "_block", "_sent")


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, text, tree and fingerprint (the tree's root) of each row of ``docs``; a null text counts as empty.

    Other columns are ignored. Repeated rows give repeated rows; an empty table gives none. A row holds its text and
    its tree, about as large as the text.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("tree", tree(F.col("text"))).withColumn("fingerprint", root(F.col("tree")))


def op2_merkle(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, compared with those and with the next document's.

    An empty table gives no rows; in a table of one row the next document is that row. A row holds three texts and
    their trees while it is compared, however long they are.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(docs, "text")
    n = F.char_length("text")
    k = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_text", F.lit(1), k))
    t = pairs.select("doc_id", "text", "next_text", edited.alias("edited"), n.cast("long").alias("n_chars"))
    t = t.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("text")).alias("own"), tree(F.col("edited")).alias("new"), tree(F.col("next_text")).alias("next"))
    own, new, following = F.col("own"), F.col("new"), F.col("next")
    t = t.select("*", root(own).alias("fingerprint"), root(new).alias("edited_fingerprint"), likeness(own, new).alias("near_edited"), likeness(own, following).alias("near_next"), first_edit(own, new).alias("edit"))
    return t.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.size("own").cast("long").alias("n_sections"),
        F.col("edit.section").alias("edit_section"), F.col("edit.paragraph").alias("edit_paragraph"), F.col("edit.leaf").alias("edit_leaf"),
    )


def _oracle() -> str:
    leaf = f"substr(sha256(l), 1, {LEAF_DIGITS})"
    paragraph = f"[{leaf} for l in regexp_extract_all(p, '{LEAF}')]"
    tree_sql = f"[[{paragraph} for p in string_split(s, chr(10))] for s in string_split(%s, chr(10) || chr(10))]"
    # A branch by its digest; what lies below is looked up in the tree itself.
    section = "sha256(array_to_string([sha256(array_to_string(p, '')) for p in s], ''))"
    count = "greatest(len(p), 1)"

    def near(x: str, y: str) -> str:
        return f"""SELECT rn,
  list_sum([list_sum([{count} for p in s]) for s in list_distinct(list_intersect({x}, {y}))]) AS whole,
  list_distinct(flatten([s for s in {x} if NOT list_contains({y}, s)])) AS p, list_distinct(flatten([s for s in {y} if NOT list_contains({x}, s)])) AS q FROM t"""

    def rest(name: str) -> str:
        return f"""SELECT rn, coalesce(whole, 0) + coalesce(list_sum([{count} for p in list_distinct(list_intersect(p, q))]), 0) AS same,
  list_distinct(flatten([CASE WHEN len(x) = 0 THEN [''] ELSE x END for x in p if NOT list_contains(q, x)])) AS a,
  list_distinct(flatten([CASE WHEN len(x) = 0 THEN [''] ELSE x END for x in q if NOT list_contains(p, x)])) AS b FROM {name}"""

    def share(name: str) -> str:
        return f"SELECT rn, 2.0::DOUBLE * (same + len(list_intersect(a, b))) / (2 * same + len(a) + len(b)) AS share FROM {name}"

    def differ(a: str, b: str) -> str:
        return f"list_min([z for z in range(1, greatest(len({a}), len({b})) + 1) if NOT coalesce({a}[z] = {b}[z], false)])"

    def in_place(a: str, b: str) -> str:
        least = f"least(len({a}), len({b}))"
        begin, end = (f"coalesce({differ(x, y)} - 1, {least})" for x, y in ((a, b), (f"list_reverse({a})", f"list_reverse({b})")))
        return f"CAST(least({begin} + {end}, {least}) AS DOUBLE) / greatest(len({a}), len({b}))"

    def near_by(tree: str, roots: str, name: str) -> str:
        n, m = (f"list_sum([list_sum([{count} for p in s]) for s in {x}])" for x in ("own", tree))
        flat = lambda x: f"[sha256(array_to_string(p, '')) for p in flatten({x})]"
        return f"""SELECT rn, CASE WHEN a = {roots} THEN 1.0::DOUBLE ELSE {COMMON}::DOUBLE * share * least({n}, {m}) / greatest({n}, {m})
  + (1 - {COMMON}::DOUBLE) * ({in_place("a", roots)} + {in_place("f", "g")}) / 2 END AS near FROM (SELECT *, {flat("own")} AS f, {flat(tree)} AS g FROM d) JOIN {name} USING (rn)"""

    return f"""
WITH docs AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT rn, doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC, text DESC), first_value(text) OVER (ORDER BY doc_id DESC, text DESC)) AS next_text FROM docs),
e AS (SELECT *, CAST(length(text) AS BIGINT) AS n_chars, substring(text, 1, length(text) - CAST(floor(length(text) / 3) AS INT)) || substring(next_text, 1, CAST(floor(length(text) / 3) AS INT)) AS edited FROM n),
t AS (SELECT rn, doc_id, n_chars, sha256(edited) AS edited_sha256, {tree_sql % "text"} AS own, {tree_sql % "edited"} AS new, {tree_sql % "next_text"} AS nxt FROM e),
d AS (SELECT *, [{section} for s in own] AS a, [{section} for s in new] AS b, [{section} for s in nxt] AS c FROM t),
i AS (SELECT *, {differ("a", "b")} AS i FROM d),
j AS (SELECT *, {differ("coalesce(own[i], [['?']])", "coalesce(new[i], [['?']])")} AS j FROM i),
k AS (SELECT *, CASE WHEN i IS NOT NULL THEN {differ("(CASE WHEN len(coalesce(own[i][j], [])) = 0 THEN [''] ELSE own[i][j] END)", "(CASE WHEN len(coalesce(new[i][j], [])) = 0 THEN [''] ELSE new[i][j] END)")} END AS k FROM j),
e1 AS ({near("own", "new")}), e2 AS ({rest("e1")}), e3 AS ({share("e2")}), e4 AS ({near_by("new", "b", "e3")}),
x1 AS ({near("own", "nxt")}), x2 AS ({rest("x1")}), x3 AS ({share("x2")}), x4 AS ({near_by("nxt", "c", "x3")})
SELECT doc_id, n_chars, edited_sha256, sha256(array_to_string(a, '')) AS fingerprint, sha256(array_to_string(b, '')) AS edited_fingerprint,
  e4.near AS near_edited, x4.near AS near_next, CAST(len(own) AS BIGINT) AS n_sections,
  CAST(i - 1 AS BIGINT) AS edit_section, CAST(CASE WHEN i IS NOT NULL THEN j - 1 END AS BIGINT) AS edit_paragraph, CAST(k - 1 AS BIGINT) AS edit_leaf
FROM k JOIN e4 USING (rn) JOIN x4 USING (rn)
"""


ORACLE = _oracle()
