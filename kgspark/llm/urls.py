"""URL verdicts by rules, and beyond them by a ratio of character language models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm._shared import materialize

#: Verdict, host and path of each rule.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Longest context, weight of the next shorter context's estimate, and the probability of any character without context.
ORDER, WEIGHT, UNIFORM = 3, 2.0, 1 / 96
#: The table of distinct grams is broadcast up to so many rows of about 200 bytes; a larger one is joined by shuffle.
SMALL = 100_000


def parts(url) -> tuple:
    """Host and path of a URL column; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def best_rule(host, path, rules: list[tuple[str, str, str]]):
    """The longest rule that fits, as a struct (length, rule, verdict); null if none does."""
    fits = [
        F.when(
            ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def _smoothed(side: str):
    """Probability of a gram's last character: each context's counts, filled up by the next shorter context's estimate.

    An address that is an example itself is left out of the counts that judge it, else examples would look too sure.
    """
    p = F.lit(UNIFORM)
    for k in range(ORDER + 1):
        p = (F.col(f"{side}{k}") - F.col(side) + WEIGHT * p) / (F.col(f"{side}c{k}") - F.col(side) + WEIGHT)
    return p


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Add host, path, rule, ratio and verdict to page_id and url of ``pages``; other columns are left out.

    URLs that a rule decides are the accepted and the rejected examples. Both models count characters after up to
    three others, an example being judged without its own rows. A URL without a rule is allowed if its log-likelihood difference per character reaches the
    threshold that separates the examples best, in steps of a thousandth (the lowest of equals; 0 where one kind is
    missing). Null and empty URLs have ratio 0. Rows may repeat; each distinct address is scored once. An empty table
    gives no rows.
    """
    url = F.coalesce("url", F.lit(""))
    host, path = parts(url)
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("decided"))
    rows = rows.withColumn("address", F.concat("host", "path"))
    known = rows.where(F.col("address") != "").groupBy("address").agg(F.count_if(F.col("decided") == "allow").alias("a"), F.count_if(F.col("decided") == "block").alias("r"))
    # The number is written with its address, so it is the same wherever it is read.
    known = materialize(known.withColumn("number", F.monotonically_increasing_id()))
    padded = F.concat(F.lit("~" * ORDER), F.col("address"))
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.length("address")), lambda i: F.substring(padded, i, F.lit(ORDER + 1))))
    grams = known.select("number", "a", "r", gram.alias("gram"))
    counts = materialize(grams.groupBy("gram").agg(F.sum("a").alias("a3"), F.sum("r").alias("r3")))
    table = counts
    totals = counts.agg(F.sum("a3"), F.sum("r3"), F.count("*")).first()
    for k in range(ORDER + 1):
        # k characters of context and the last one; then the context alone.
        if k < ORDER:
            tail = F.substring("gram", ORDER + 1 - k, k + 1)
            part = counts.groupBy(tail.alias("tail")).agg(F.sum("a3").alias(f"a{k}"), F.sum("r3").alias(f"r{k}"))
            table = table.join(part, F.substring(table["gram"], ORDER + 1 - k, k + 1) == part["tail"]).drop("tail")
        if k:
            part = counts.groupBy(F.substring("gram", ORDER + 1 - k, k).alias("context")).agg(F.sum("a3").alias(f"ac{k}"), F.sum("r3").alias(f"rc{k}"))
            table = table.join(part, F.substring(table["gram"], ORDER + 1 - k, k) == part["context"]).drop("context")
        else:
            table = table.withColumn("ac0", F.lit(totals[0] or 0)).withColumn("rc0", F.lit(totals[1] or 0))
    if totals[2] <= SMALL:
        table = F.broadcast(table)
    weight = F.ln(_smoothed("a") / _smoothed("r"))
    scores = grams.join(table, "gram").groupBy("number").agg((F.sum(weight) / F.count("*")).alias("ratio"))
    scores = materialize(known.join(scores, "number").select("address", "ratio"))
    # Rows without an address have no characters to judge and stay out of the join.
    scored = rows.where(F.col("address") != "").join(scores, "address", "left").withColumn("ratio", F.coalesce("ratio", F.lit(0.0)))
    scored = scored.unionByName(rows.where(F.col("address") == "").withColumn("ratio", F.lit(0.0)))
    bins = scored.where("decided is not null").groupBy(F.floor(F.col("ratio") * 1000).alias("bin")).agg(F.count_if(F.col("decided") == "allow").alias("a"), F.count_if(F.col("decided") == "block").alias("r"))
    # At most some ten thousand bins: one for each thousandth of the ratio.
    up = Window.orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    down = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    right = F.sum("a").over(up) / F.sum("a").over(every) + F.coalesce(F.sum("r").over(down), F.lit(0)) / F.sum("r").over(every)
    best = bins.select("bin", right.alias("right")).where("right is not null").orderBy(F.desc("right"), "bin").limit(1).collect()
    threshold = best[0]["bin"] / 1000 if best else 0.0
    return scored.select(
        "page_id", "url", "host", "path", "rule", "ratio", F.coalesce("decided", F.when(F.col("ratio") >= threshold, "allow").otherwise("block")).alias("verdict")
    )


def op10_url_ratio(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    fit = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{}}" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + fit.format(*[f"'{h}{p}'" for _, h, p in ordered]) + " END"
    decided = "CASE " + fit.format(*[f"'{v}'" for v, _, _ in ordered]) + " END"
    p = {s: reduce(lambda q, k: f"(({s}{k} - {s} + {WEIGHT} * {q}) / ({s}c{k} - {s} + {WEIGHT}))", range(ORDER + 1), f"CAST({UNIFORM!r} AS DOUBLE)") for s in "ar"}
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest),
hp AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
urls AS (SELECT *, host || path AS address, {rule} AS rule, {decided} AS decided FROM hp),
known AS (SELECT address, count(*) FILTER (decided = 'allow') AS a, count(*) FILTER (decided = 'block') AS r FROM urls GROUP BY address),
grams AS (SELECT address, a, r, substr('~~~' || address, i, 4) AS gram FROM (SELECT *, unnest(range(1, length(address) + 1)) AS i FROM known)),
g3 AS (SELECT gram, sum(a) AS a3, sum(r) AS r3 FROM grams GROUP BY gram),
t AS (SELECT gram, a3, r3,
  sum(a3) OVER (PARTITION BY substr(gram, 1, 3)) AS ac3, sum(r3) OVER (PARTITION BY substr(gram, 1, 3)) AS rc3,
  sum(a3) OVER (PARTITION BY substr(gram, 2, 3)) AS a2, sum(r3) OVER (PARTITION BY substr(gram, 2, 3)) AS r2,
  sum(a3) OVER (PARTITION BY substr(gram, 2, 2)) AS ac2, sum(r3) OVER (PARTITION BY substr(gram, 2, 2)) AS rc2,
  sum(a3) OVER (PARTITION BY substr(gram, 3, 2)) AS a1, sum(r3) OVER (PARTITION BY substr(gram, 3, 2)) AS r1,
  sum(a3) OVER (PARTITION BY substr(gram, 3, 1)) AS ac1, sum(r3) OVER (PARTITION BY substr(gram, 3, 1)) AS rc1,
  sum(a3) OVER (PARTITION BY substr(gram, 4, 1)) AS a0, sum(r3) OVER (PARTITION BY substr(gram, 4, 1)) AS r0,
  sum(a3) OVER () AS ac0, sum(r3) OVER () AS rc0 FROM g3),
scores AS (SELECT address, sum(ln({p["a"]} / {p["r"]})) / count(*) AS ratio FROM grams JOIN t USING (gram) GROUP BY address),
scored AS (SELECT urls.*, coalesce(ratio, 0.0) AS ratio FROM urls LEFT JOIN scores USING (address)),
bins AS (SELECT floor(ratio * 1000) AS bin, count(*) FILTER (decided = 'allow') AS a, count(*) FILTER (decided = 'block') AS r FROM scored WHERE decided IS NOT NULL GROUP BY 1),
cuts AS (SELECT bin, sum(a) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / nullif(sum(a) OVER (), 0)
  + coalesce(sum(r) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / nullif(sum(r) OVER (), 0) AS ok FROM bins),
best AS (SELECT coalesce((SELECT bin / 1000 FROM cuts WHERE ok IS NOT NULL ORDER BY ok DESC, bin LIMIT 1), 0.0) AS threshold)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN ratio >= threshold THEN 'allow' ELSE 'block' END) AS verdict FROM scored, best
"""


ORACLE = _oracle()
