"""Retrieval quality, run statistics and benchmark matrices.

Judgements: ``retrieved`` (query, pos from 1, id) and ``relevant`` (query, id).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.dates import half_up
from kgspark.functions.text import normalize_text
from kgspark.operators.phrases import automaton, found_in, match
from kgspark.session import written


def summary(rows: DataFrame, value: str, by: list[str] | None = None, most: int = 1_000_000) -> DataFrame:
    """Mean, median, population deviation, nearest-rank p95 and p99, extremes, sum and count.

    Groups of up to ``most`` values keep them together, as exact percentiles need. In larger ones, and without groups,
    the ranks are found by ranges and their counts instead, so no task holds all values of a group.
    """
    v = F.col(value)
    plain = [F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_dev"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"), F.count(v).alias("n")]
    if by:
        nearest = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)")
        sizes = rows.groupBy(*by).agg(F.count(v).alias("_c"))
        if (sizes.agg(F.max("_c")).first()[0] or 0) > most:
            out = rows.groupBy(*by).agg(*plain)
            ranked = values_at(rows, value, by, {"lo": lambda n: F.floor((n + 1) / 2), "hi": lambda n: F.floor(n / 2) + 1, "p95": lambda n: F.ceil(n * 95 / 100), "p99": lambda n: F.ceil(n * 99 / 100)}, most)
            same = [F.col(f"_o.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in by]
            out = out.alias("_o").join(ranked.alias("_r"), same, "left").select("_o.*", ((F.col("lo").cast("double") + F.col("hi").cast("double")) / 2).alias("median"), "p95", "p99")
        else:
            out = rows.groupBy(*by).agg(*plain, F.median(v).alias("median"), nearest(0.95).alias("p95"), nearest(0.99).alias("p99"))
    else:
        n = rows.agg(F.count(v)).first()[0]
        at = lambda rank: value_at(rows, value, rank) if n else None
        kind = rows.schema[value].dataType.simpleString()
        middle = [at((n + 1) // 2), at(n // 2 + 1)]
        found = {"median": (F.lit(middle[0]).cast("double") + F.lit(middle[1]).cast("double")) / 2, "p95": F.lit(at(-(-n * 95 // 100))).cast(kind), "p99": F.lit(at(-(-n * 99 // 100))).cast(kind)}
        out = rows.agg(*plain).withColumns(found)
    return out.select(*(by or []), "mean", "median", "std_dev", "p95", "p99", "min", "max", "sum", "n")


#: Rows among which a rank is looked up at once.
_FEW = 100_000


def value_at(rows: DataFrame, value: str, rank: int):
    """The value of a rank (from 1) in ascending order, exactly, without sorting all values.

    Approximate percentiles bound a range round the rank, counts make the rank within it exact, and the range is
    narrowed until few values are left. Nulls have no rank.
    """
    part, below = rows.select(F.col(value).alias("v")).where("v is not null"), 0
    while True:
        n = part.count()
        if n <= _FEW:
            w = Window.orderBy("v")
            return part.groupBy("v").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(w)).where(F.col("upto") >= rank - below).agg(F.min("v")).first()[0]
        share = (rank - below) / n
        low, high = part.agg(F.percentile_approx("v", [max(0.0, share - 0.002), min(1.0, share + 0.002)], 10_000)).first()[0]
        if low == high:
            return low
        under, inside = part.agg(F.count_if(F.col("v") < low), F.count_if((F.col("v") >= low) & (F.col("v") <= high))).first()
        if inside == n:
            # So few different values that they can be counted.
            w = Window.orderBy("v")
            return part.groupBy("v").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(w)).where(F.col("upto") >= rank - below).agg(F.min("v")).first()[0]
        part, below = part.where((F.col("v") >= low) & (F.col("v") <= high)), below + under


#: Ranges in which ranks are looked up, at most; their size then grows with the table.
_RANGES = 1024


def values_at(rows: DataFrame, value: str, by: list[str], ranks: dict, few: int = _FEW) -> DataFrame:
    """For each group the values of several ranks in ascending order, exactly: ``by`` and a column for each name of ``ranks``.

    ``ranks``: functions from a column of group sizes to a rank (from 1). Equal values of a group are counted first, then
    dealt to ranges of (group, value) of about ``few`` different values, or more where that makes over _RANGES ranges.
    The ranges' counts tell in which one a rank lies, and only within it values are counted up. Whatever ties there are,
    the values are shuffled twice. Groups without values have no row.
    """
    v = F.col(value)
    counted = written(rows.where(v.isNotNull()).select(F.struct(*by).alias("g"), v.alias("v")).groupBy("g", "v").agg(F.count("*").alias("c")))
    different = counted.count()
    parts = max(1, -(-different // max(few, different // _RANGES)))
    counted = written(counted.repartitionByRange(parts, "g", "v").withColumn("_part", F.spark_partition_id()))
    # A row for each range and group in it.
    held = counted.groupBy("g", "_part").agg(F.sum("c").alias("held"))
    held = written(held.withColumns({"upto": F.sum("held").over(Window.partitionBy("g").orderBy("_part")), "n": F.sum("held").over(Window.partitionBy("g"))}))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), f(F.col("n")).cast("long").alias("rank")) for k, f in ranks.items()])).alias("x")
    wanted = held.select("g", "_part", "held", "upto", wanted).where("x.rank <= upto and x.rank > upto - held")
    wanted = written(wanted.select("g", "_part", "x.name", (F.col("x.rank") - F.col("upto") + F.col("held")).alias("rank")))
    some = wanted.select("g", "_part").distinct()
    same = lambda a, b: [F.col(f"{a}._part") == F.col(f"{b}._part"), F.col(f"{a}.g").eqNullSafe(F.col(f"{b}.g"))]
    near = counted.alias("c").join(some.alias("s"), same("c", "s"), "left_semi").withColumn("_at", F.sum("c").over(Window.partitionBy("_part", "g").orderBy("v")))
    found = near.alias("f").join(wanted.alias("w"), same("f", "w")).where((F.col("f._at") >= F.col("w.rank")) & (F.col("f._at") - F.col("f.c") < F.col("w.rank")))
    return found.select("f.g", "w.name", "f.v").groupBy("g").pivot("name", list(ranks)).agg(F.first("v")).select("g.*", *ranks)


def judged(retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """Retrieved rows with 1 for relevant ones in ``rel``."""
    hit = relevant.select("query", "id").distinct().withColumn("rel", F.lit(1))
    return retrieved.join(hit, ["query", "id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def precision_recall(retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each query that has either side."""
    got = judged(retrieved, relevant).groupBy("query").agg(F.sum("rel").alias("hits"), F.count("*").alias("n"))
    want = relevant.select("query", "id").distinct().groupBy("query").agg(F.count("*").alias("m"))
    both = got.join(want, "query", "full_outer").fillna(0, ["hits", "n", "m"])
    p = F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0)
    r = F.when(F.col("m") > 0, F.col("hits") / F.col("m")).otherwise(0.0)
    return both.select("query", p.alias("precision"), r.alias("recall")).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def mrr_ndcg(retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """Reciprocal rank and NDCG of each query with results (D27); the ideal ranks all relevant rows."""
    j = judged(retrieved, relevant)
    gain = F.when(F.col("rel") == 1, 1 / F.log2(F.col("pos") + 1)).otherwise(0.0)
    got = j.groupBy("query").agg(F.coalesce(1 / F.min(F.when(F.col("rel") == 1, F.col("pos"))), F.lit(0.0)).alias("mrr"), F.sum(gain).alias("dcg"))
    m = relevant.select("query", "id").distinct().groupBy("query").agg(F.count("*").alias("m"))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("m")), lambda i: 1 / F.log2(i + 1)), F.lit(0.0), lambda s, x: s + x)
    both = got.join(m, "query", "left").withColumn("idcg", F.when(F.col("m") > 0, ideal).otherwise(0.0))
    return both.select("query", "mrr", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def average_precision(retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """Average precision of each query with relevant rows."""
    w = Window.partitionBy("query").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    j = judged(retrieved, relevant).withColumn("seen", F.sum("rel").over(w)).withColumn("p", F.when(F.col("rel") == 1, F.col("seen") / F.col("pos")).otherwise(0.0))
    total = j.groupBy("query").agg(F.sum("p").alias("s"))
    m = relevant.select("query", "id").distinct().groupBy("query").agg(F.count("*").alias("m"))
    return m.join(total, "query", "left").select("query", (F.coalesce("s", F.lit(0.0)) / F.col("m")).alias("ap"))


def rates_at(retrieved: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Over all judged queries: mean average precision, hit rate and coverage at k."""
    ap = average_precision(retrieved, relevant)
    top = judged(retrieved.where(F.col("pos") <= k), relevant).groupBy("query").agg(F.max("rel").alias("hit"), F.countDistinct(F.when(F.col("rel") == 1, F.col("id"))).alias("found"))
    m = relevant.select("query", "id").distinct().groupBy("query").agg(F.count("*").alias("m"))
    rows = ap.join(m, "query").join(top, "query", "left")
    return rows.agg(F.avg("ap").alias("map"), F.avg(F.coalesce("hit", F.lit(0))).alias("hit_rate"), F.avg(F.coalesce("found", F.lit(0)) / F.col("m")).alias("coverage"))


def score_histogram(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of high, medium and low scores, and the mean."""
    s = F.col("score")
    return rows.groupBy(*(by or [])).agg(F.count_if(s > 0.8).alias("high"), F.count_if((s >= 0.6) & (s <= 0.8)).alias("medium"), F.count_if(s < 0.6).alias("low"), F.coalesce(F.avg(s), F.lit(0.0)).alias("mean_score"))


def speedup(base: Column, other: Column) -> Column:
    """How many times faster (H35); 0 for no time."""
    return F.when(other == 0, 0.0).otherwise(base / other)


def savings(base: Column, other: Column) -> Column:
    """Share saved in percent."""
    return F.when(base == 0, 0.0).otherwise((base - other) / base * 100)


def matrix_cells(runs: DataFrame) -> DataFrame:
    """Mean time, tokens and cost of each agent and setup (C26, D30), times and tokens rounded."""
    return runs.groupBy("agent", "setup").agg(half_up(F.avg("time")).alias("time"), half_up(F.avg("tokens")).alias("tokens"), F.avg("cost").alias("cost"), F.count("*").alias("n"))


def matrix_analysis(runs: DataFrame, base: str, other: str) -> DataFrame:
    """Speed-up and savings of a setup over another for each agent, and its best setup by time + 1000 * cost."""
    cells = matrix_cells(runs)
    wide = cells.groupBy("agent").pivot("setup", [base, other]).agg(F.first("time").alias("time"), F.first("tokens").alias("tokens"), F.first("cost").alias("cost"))
    best = cells.groupBy("agent").agg(F.min_by("setup", F.struct(F.col("time") + 1000 * F.col("cost"), F.col("setup"))).alias("best"))
    b, o = (lambda c: F.col(f"{base}_{c}")), (lambda c: F.col(f"{other}_{c}"))
    return wide.join(best, "agent").select(
        "agent", speedup(b("time"), o("time")).alias("speedup"), savings(b("tokens"), o("tokens")).alias("token_savings"), savings(b("cost"), o("cost")).alias("cost_savings"), "best"
    )


def scenario_matrix(agents: DataFrame, scenarios: DataFrame, setups: list[str], iterations: int, most: int = 10_000) -> DataFrame:
    """Every agent with every scenario, setup and iteration (C26). The product is the result; scenarios are a stated list of at most ``most``."""
    names = [r[0] for r in scenarios.select("scenario").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"over {most} scenarios")
    every = lambda values: F.explode(F.array(*map(F.lit, values)))
    return agents.select("agent").withColumn("scenario", every(names)).withColumn("setup", every(setups)).withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(iterations))))


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Similarity of two id sets of each query."""
    x = a.select("query", "id").distinct().withColumn("x", F.lit(1))
    y = b.select("query", "id").distinct().withColumn("y", F.lit(1))
    return x.join(y, ["query", "id"], "full_outer").groupBy("query").agg((F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()) / F.count("*")).alias("jaccard"))


def run_log(log: DataFrame, run: DataFrame) -> DataFrame:
    """A log (start, and counts) with one more run, each row with the totals of its day."""
    rows = log.unionByName(run)
    counts = [c for c, kind in rows.dtypes if kind in ("int", "bigint", "double")]
    day = F.to_date("start").alias("day")
    totals = rows.groupBy(day).agg(*[F.sum(c).alias(f"day_{c}") for c in counts])
    return rows.withColumn("day", day).join(totals, "day").drop("day")


def next_range(log: DataFrame, days: int) -> DataFrame:
    """The next range to make ends where the earliest one starts."""
    return log.agg(F.min("start").alias("end")).select(F.date_sub("end", days).alias("start"), "end")


def _item_index(pairs: list[tuple]) -> tuple:
    """Items by text, a searcher for whole ones, and for each counted word the items it counts for, as often as they have it."""
    texts = sorted({t for _, t in pairs})
    ids: dict = {t: [] for t in texts}
    for k, t in pairs:
        ids[t].append(k)
    words = [[w for w in t.split(" ") if len(w) > 2] for t in texts]
    postings: dict = {}
    for i, ws in enumerate(words):
        for w in ws:
            postings.setdefault(w, []).append(i)
    needed = np.array([0.7 * len(ws) if ws else np.inf for ws in words])
    return automaton(texts), {w: np.array(x) for w, x in postings.items()}, needed, [ids[t] for t in texts], [i for i, t in enumerate(texts) if not t]


def _items_met(state: tuple, text: str) -> list:
    searcher, postings, needed, ids, every = state
    own = [postings[w] for w in set(text.split(" ")) if w in postings]
    met = set(np.flatnonzero(np.bincount(np.concatenate(own), minlength=len(ids)) >= needed).tolist()) if own else set()
    return list(dict.fromkeys(k for i in sorted(met | found_in(searcher, text) | set(every)) for k in ids[i]))


def matched_items(responses: DataFrame, items: DataFrame) -> DataFrame:
    """Which responses (doc_id, text) satisfy which required items (item_id, text) (H34): doc_id, item_id.

    An item is satisfied if it stands whole in a response or if 0.7 of its words of over two letters do. Items are a
    stated query set: they go out in blocks of bounded size, and one pass over the responses for each block looks up
    every word once and searches for all whole items at a time; no text is shuffled. Null texts satisfy nothing; an
    item without words is in every response. Repeated rows give one row.
    """
    r = responses.select("doc_id", normalize_text(F.col("text")).alias("r"))
    i = items.select("item_id", normalize_text(F.col("text")).alias("i"))
    return match(r, "doc_id", "r", i, "item_id", "i", _item_index, _items_met).distinct()


def evaluate(retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """Precision, recall, F1, reciprocal rank, NDCG and Jaccard of each query."""
    return precision_recall(retrieved, relevant).join(mrr_ndcg(retrieved, relevant), "query", "left").join(jaccard(retrieved, relevant), "query", "left").fillna(0.0, ["mrr", "ndcg"])


def formatted(metrics: DataFrame, names: list[str]) -> DataFrame:
    """A line of text for each query."""
    parts = [F.format_string(f"{n}: %.3f", F.col(n)) for n in names]
    return metrics.select("query", F.concat_ws(", ", *parts).alias("line"))
