"""Graph tables: nodes (id, ...), edges (src, dst, type, confidence) and what is derived from them.

Every function takes and returns DataFrames. Edges are directed; their key is (src, type, dst).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.dates import half_up
from kgspark.functions.ids import entity_id, relationship_id, relationship_key
from kgspark.functions.text import GENERIC_RELATIONSHIPS, HIGH_VALUE_TYPES, normalize_name, relationship_text
from kgspark.session import written

EDGE_KEY = ["src", "type", "dst"]
#: Ids that one task sorts to look others up among them.
TASK_IDS = 500_000
MENTION_TYPES = ["MENTIONED_IN", "MENTIONS_REL"]


def one_hop(edges: DataFrame, ids: DataFrame, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """Edges that touch the ids (column id), with ``anchor`` and ``other`` end (C4). A self-loop appears once."""
    if types:
        edges = edges.where(F.col("type").isin(types))
    out = edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select("*", F.col("src").alias("anchor"), F.col("dst").alias("other"))
    back = edges.join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(*edges.columns, F.col("dst").alias("anchor"), F.col("src").alias("other"))
    out, back = out.select(*edges.columns, "anchor", "other"), back
    if direction == "out":
        return out
    if direction == "in":
        return back
    return out.unionByName(back.where("src <> dst"))


def degree(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Outgoing edges of each id, 0 without any."""
    counts = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return ids.select("id").distinct().join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def node_rank(count: Column) -> Column:
    """Degree as a rank of at most 100."""
    return F.least(half_up(count / 10 * 100), F.lit(100))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (C11)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def _without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is not among ``ids``, about TASK_IDS of which are sorted by a task.

    Adaptive execution would size tasks by shuffled bytes, of which ids that differ little have few for many rows.
    """
    n = -(-ids.count() // TASK_IDS)
    if n > 1:
        rows, ids = rows.repartition(n, "id"), ids.repartition(n, "id")
    return rows.join(ids, "id", "left_anti")


def orphan_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge in either direction."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
    return _without(nodes, ends)


def orphan_edges(edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """Edges that no record mentions, the mention edges themselves apart (C13); ``mentions``: src, type, dst, record_id."""
    return edges.where(~F.col("type").isin(MENTION_TYPES)).join(mentions.select(*EDGE_KEY).distinct(), EDGE_KEY, "left_anti")


def without_mentions(metadata: DataFrame, mentions: DataFrame) -> DataFrame:
    """Metadata rows (id) that have no mention (C14)."""
    return _without(metadata, mentions.select(F.col("rel_id").alias("id")))


def not_in_graph(metadata: DataFrame, nodes: DataFrame) -> DataFrame:
    """Metadata rows whose node is gone."""
    return _without(metadata, nodes.select("id"))


def all_sources_deleted(sources: DataFrame, records: DataFrame) -> DataFrame:
    """Items (item_id) all of whose records are deleted or missing (C16); ``sources``: item_id, record_id."""
    state = records.select(F.col("_id").alias("record_id"), F.col("deleted_at").isNotNull().alias("gone"))
    return sources.join(state, "record_id", "left").groupBy("item_id").agg(F.bool_and(F.coalesce("gone", F.lit(True))).alias("gone")).where("gone").select("item_id")


def remove_document(nodes: DataFrame, edges: DataFrame, mentions: DataFrame, record_ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Take records' mentions away and what nothing mentions any more (C17); returns nodes, edges, mentions."""
    kept = mentions.join(record_ids.select("record_id"), "record_id", "left_anti").select(*mentions.columns)
    touched = mentions.join(record_ids.select("record_id"), "record_id", "left_semi").select(*EDGE_KEY).distinct()
    gone = touched.join(kept.select(*EDGE_KEY), EDGE_KEY, "left_anti")
    left = edges.join(gone, EDGE_KEY, "left_anti")
    ends = gone.select(F.col("src").alias("id")).union(gone.select(F.col("dst").alias("id"))).distinct()
    lost = orphan_nodes(ends, left)
    return nodes.join(lost, "id", "left_anti"), left, kept


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without some nodes and their edges."""
    ids = ids.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*edges.columns)
    return nodes.join(ids, "id", "left_anti"), left


def one_of(rows: DataFrame, key: str, order: str | None = None, last: bool = True) -> DataFrame:
    """One row of each key: the last or first by ``order``, then by the other columns, never by the order of rows."""
    rest = [c for c in rows.columns if c != key]
    if not rest:
        return rows.distinct()
    by = F.struct(*([F.col(order)] if order else []), *[F.col(c) for c in rest if c != order])
    return rows.groupBy(key).agg((F.max if last else F.min)(F.struct(by.alias("by"), F.struct(*rest).alias("row"))).alias("x")).select(key, "x.row.*").select(*rows.columns)


def upsert_nodes(old: DataFrame, new: DataFrame, keep_description: bool = True, order: str | None = None) -> DataFrame:
    """Nodes of both by id; the new one's fields win, but a null description leaves the old one.

    Of new rows with the same id the last by ``order`` counts (a column of ``new`` that need not be one of ``old``).
    """
    latest = one_of(new, "id", order)
    o = old.select("id", F.struct(*old.columns).alias("o"))
    n = latest.select("id", F.struct(*latest.columns).alias("n"))
    both = o.join(n, "id", "full_outer")
    cols = []
    for c in old.columns:
        if c == "id":
            cols.append(F.col("id"))
        elif c not in latest.columns:
            cols.append(F.col(f"o.{c}").alias(c))
        elif c == "description" and keep_description:
            cols.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
        else:
            cols.append(F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*cols)


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of both by key; the new confidence wins."""
    tagged = old.select(*EDGE_KEY, "confidence", F.lit(0).alias("_new")).unionByName(new.select(*EDGE_KEY, "confidence", F.lit(1).alias("_new")))
    return tagged.groupBy(*EDGE_KEY).agg(F.max_by("confidence", F.struct("_new", "confidence")).alias("confidence"))


def missing_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that edges name and nodes lack; a batch upsert creates them."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti")


def upsert_document_edges(old: DataFrame, new: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges between documents: only those with both ends are taken."""
    return upsert_edges(old, induced(new, documents))


def link_mentions(links: DataFrame, entities: DataFrame, documents: DataFrame) -> DataFrame:
    """Mention edges of entities and documents that both exist (A21); ``links``: entity_id, record_id, confidence."""
    kept = links.join(entities.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi").join(documents.select(F.col("id").alias("record_id")).distinct(), "record_id", "left_semi")
    return kept.groupBy(F.col("entity_id").alias("src"), F.lit("MENTIONED_IN").alias("type"), F.col("record_id").alias("dst")).agg(F.max(F.coalesce("confidence", F.lit(1.0))).alias("confidence"))


def add_mentions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Mentions by (rel_id, record_id); the latest extraction wins (A24), of equal times the one largest in all other columns."""
    key = ["rel_id", "record_id"]
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in (*key, "extracted_at")]
    return both.groupBy(*key).agg(F.max(F.struct("extracted_at", *rest)).alias("m")).select(*key, "m.*").select(*both.columns)


def page(nodes: DataFrame, edges: DataFrame, skip: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """A page of nodes in id order and the edges among them."""
    some = nodes.orderBy("id").offset(skip).limit(min(limit, 1000))
    return some, induced(edges, some)


def paths(edges: DataFrame, source: str, target: str, max_depth: int = 5, limit: int = 10) -> DataFrame:
    """Undirected walks between two nodes of 1 to ``max_depth`` edges that repeat no edge (C23): nodes and depth.

    The shortest ones first, then by their nodes, ``limit`` at most. Partial walks are taken in the order of their
    nodes' names: all that goes on from an earlier one comes before all that goes on from a later one, so only the
    first few of each length have to be kept, however many edges a hub has. They step on nodes that can reach the
    target in exactly the edges left, which are found from the target as sets. Where too few of those that were kept
    get there without repeating an edge, more are kept. Names hold no ">".
    """
    key = F.concat_ws("|", "src", "type", "dst")
    step = written(edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), key.alias("edge")).union(edges.where("src <> dst").select("dst", "src", key)).distinct())
    spark = edges.sparkSession
    reach = [spark.createDataFrame([(target,)], "to string")]
    for _ in range(1, max_depth):
        reach.append(written(step.join(reach[-1], "to", "left_semi").select(F.col("at").alias("to")).distinct()))
    schema = "line string, nodes array<string>, edges array<string>, last string"
    found: list[tuple] = []
    for depth in range(1, max_depth + 1):
        keep = max(64, 4 * limit)
        while True:
            level, cut = [(source, [source], [], source)], False
            for left in range(depth - 1, -1, -1):
                walks = F.broadcast(spark.createDataFrame(level, schema))  # at most ``keep``, and ties of parallel edges
                on = step.join(walks, F.col("last") == F.col("at")).where(~F.array_contains("edges", F.col("edge"))).join(reach[left], "to", "left_semi")
                on = on.select(F.concat("line", F.lit(">"), "to").alias("line"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("edges", F.array("edge")).alias("edges"), F.col("to").alias("last"))
                best = on.withColumn("r", F.rank().over(Window.orderBy(F.concat("line", F.lit(">"))))).where(F.col("r") <= keep + 1).collect()
                cut = cut or any(r["r"] > keep for r in best)
                level = [(r["line"], r["nodes"], r["edges"], r["last"]) for r in best if r["r"] <= keep]
                if not level:
                    break
            if not cut or len(level) >= limit - len(found):
                break
            keep *= 4
        found += [(x[1], depth) for x in sorted(level)][: limit - len(found)]
        if len(found) == limit:
            break
    return spark.createDataFrame(found, "nodes array<string>, depth int")


def score_map(edges: DataFrame, initial: DataFrame) -> DataFrame:
    """Score of each id: the highest of its first score and its edges' confidence (D21); ``initial``: id, score."""
    confidence = F.coalesce("confidence", F.lit(0.0)).alias("score")
    every = edges.select(F.col("src").alias("id"), confidence).union(edges.select(F.col("dst").alias("id"), confidence)).union(initial.select("id", "score"))
    return every.groupBy("id").agg(F.max("score").alias("score"))


def merge_relationships(rels: DataFrame) -> DataFrame:
    """One relationship a key: mean strength rounded half up, the first one's names and description.

    ``rels``: ord, source, target, type, description, strength.
    """
    key = relationship_key(F.col("source"), F.col("type"), F.col("target"))
    first = F.min_by(F.struct("source", "target", "type", "description"), F.col("ord")).alias("f")
    return rels.groupBy(key.alias("key")).agg(first, half_up(F.avg("strength")).alias("strength")).select("f.*", "strength")


def dedupe_entities(entities: DataFrame, most: int = 6) -> DataFrame:
    """Entities by normalized name: first casing, dominant type (first seen of equals), up to six descriptions.

    ``entities``: ord, name, type, description.
    """
    e = entities.withColumn("key", normalize_name(F.col("name")))
    kinds = e.groupBy("key", "type").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    kind = kinds.groupBy("key").agg(F.max_by("type", F.struct(F.col("n"), -F.col("first"))).alias("type"))
    told = e.where(F.coalesce("description", F.lit("")) != "").groupBy("key", "description").agg(F.min("ord").alias("ord"))
    told = told.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "description"))).alias("d"))
    names = e.groupBy("key").agg(F.min_by("name", "ord").alias("name"))
    text = F.array_join(F.transform(F.slice("d", 1, most), lambda x: x["description"]), " ||| ")
    text = F.when(F.size("d") > most, F.concat(text, F.lit(" [...]"))).otherwise(F.coalesce(text, F.lit("")))
    return names.join(kind, "key").join(told, "key", "left").select("key", "name", "type", text.alias("description"))


def first_wins(entities: DataFrame) -> DataFrame:
    """The first entity of each normalized name over all records (D18); ``entities``: doc_ord, pos, name, type, description."""
    w = Window.partitionBy(normalize_name(F.col("name"))).orderBy("doc_ord", "pos")
    return entities.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumn("id", entity_id(F.col("type"), F.col("name")))


def filter_low_value(rels: DataFrame) -> DataFrame:
    """Without generic types and weak relationships; strength 0 or null is kept."""
    weak = F.coalesce((F.col("strength") != 0) & (F.col("strength") < 5), F.lit(False))
    return rels.where(~F.upper("type").isin(GENERIC_RELATIONSHIPS) & ~weak)


def toxic_documents(entities: DataFrame, rels: DataFrame, least: int = 50, most: int = 5, length: float = 20) -> DataFrame:
    """Records that are lists: many entities, few relationships, short names (B22); both have record_id."""
    e = entities.groupBy("record_id").agg(F.count("*").alias("n"), F.avg(F.length("name")).alias("avg_len"))
    r = rels.groupBy("record_id").agg(F.count("*").alias("r"))
    return e.join(r, "record_id", "left").where((F.col("n") >= least) & (F.coalesce("r", F.lit(0)) <= most) & (F.col("avg_len") < length)).select("record_id")


def truncate_entities(entities: DataFrame, chars_per_entity: int | None = None, max_entities: int | None = None) -> DataFrame:
    """The first entities of each record, as many as its length allows (B23); ``entities``: record_id, pos, content_length."""
    if not chars_per_entity and not max_entities:
        return entities
    limit = F.ceil(F.col("content_length") / chars_per_entity) if chars_per_entity else F.lit(max_entities)
    limit = F.least(limit, F.lit(max_entities)) if chars_per_entity and max_entities else limit
    w = Window.partitionBy("record_id").orderBy("pos")
    return entities.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def preserved_entities(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """Entities worth keeping: of a high-value type, well described, or an end of a relationship."""
    ends = rels.select(normalize_name(F.col("source")).alias("key")).union(rels.select(normalize_name(F.col("target")))).distinct().withColumn("linked", F.lit(True))
    e = entities.withColumn("key", normalize_name(F.col("name"))).join(ends, "key", "left")
    keep = F.upper("type").isin(HIGH_VALUE_TYPES) | (F.coalesce(F.length("description"), F.lit(0)) >= 50) | F.coalesce("linked", F.lit(False))
    return e.where(keep).select(*entities.columns)


def resolve_relationships(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships between node ids; both names must resolve (C9); confidence is a tenth of the strength (Q11)."""
    ids = entities.groupBy(normalize_name(F.col("name")).alias("key")).agg(F.min("id").alias("id"))
    r = rels.withColumn("s", normalize_name(F.col("source"))).withColumn("t", normalize_name(F.col("target")))
    r = r.join(ids.withColumnsRenamed({"key": "s", "id": "src"}), "s").join(ids.withColumnsRenamed({"key": "t", "id": "dst"}), "t")
    return r.select("src", "dst", "type", (F.col("strength") / 10).alias("confidence"), relationship_id(F.col("src"), F.col("type"), F.col("dst")).alias("id"))


def build_graph(entities: DataFrame, rels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of extraction results (I10): filter, merge, keep what matters, first wins, resolve."""
    merged = merge_relationships(filter_low_value(rels))
    nodes = first_wins(preserved_entities(entities, merged))
    return nodes, resolve_relationships(merged, nodes)


def missing_entities(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """Names that relationships use and no entity has, with an inferred type."""
    from kgspark.functions.text import type_from_relationship

    ends = rels.select("ord", "type", F.col("source").alias("name")).union(rels.select("ord", "type", F.col("target")))
    ends = ends.withColumn("key", normalize_name(F.col("name")))
    lost = ends.join(entities.select(normalize_name(F.col("name")).alias("key")), "key", "left_anti")
    first = F.min_by(F.struct("name", "type"), F.struct("ord", "name")).alias("f")
    return lost.groupBy("key").agg(first).select("key", "f.name", type_from_relationship(F.col("f.type")).alias("type"))


def provenance(mentions: DataFrame) -> DataFrame:
    """Records of each item, in order (D19); ``mentions``: item_id, record_id."""
    return mentions.groupBy("item_id").agg(F.array_sort(F.collect_set("record_id")).alias("record_ids"))


def upsert_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """Metadata by id with the union of both sides' source_record_ids; the new checksum wins."""
    o = old.select("id", F.col("source_record_ids").alias("o"), F.col("checksum").alias("oc"))
    n = new.select("id", F.col("source_record_ids").alias("n"), F.col("checksum").alias("nc"))
    none = F.array().cast("array<string>")
    return o.join(n, "id", "full_outer").select("id", F.array_sort(F.array_union(F.coalesce("o", none), F.coalesce("n", none))).alias("source_record_ids"), F.coalesce("nc", "oc").alias("checksum"))


def remove_provenance(metadata: DataFrame, record_id: str) -> DataFrame:
    """Metadata without a record; rows that lose their last one go."""
    return metadata.withColumn("source_record_ids", F.array_remove("source_record_ids", record_id)).where(F.size("source_record_ids") > 0)


def neighbours_of_document(edges: DataFrame, record_id: str, type_: str) -> DataFrame:
    """Ends of a document's edges of one type (I16)."""
    return edges.where((F.col("type") == type_) & (F.col("dst") == record_id)).select(F.col("src").alias("id")).union(edges.where((F.col("type") == type_) & (F.col("src") == record_id)).select("dst")).distinct()


def edges_by_type(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("n"))


def discover_types(found: DataFrame, known: DataFrame) -> DataFrame:
    """Types that the registry lacks."""
    return found.select("type").distinct().join(known.select("type"), "type", "left_anti")


def existing_ids(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of some ids that are nodes."""
    return ids.join(nodes.select("id"), "id", "left_semi")


def existing_edges(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """Those of some edge keys that are edges."""
    return keys.join(edges.select(*EDGE_KEY), EDGE_KEY, "left_semi")


def edges_from(edges: DataFrame, prefix: str, skip: int = 0, limit: int = 1000) -> DataFrame:
    """A page of the edges whose source starts with a text; a missing confidence counts as 1."""
    rows = edges.where(F.startswith("src", F.lit(prefix))).withColumn("confidence", F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 1.0).otherwise(F.col("confidence")))
    return rows.orderBy(*EDGE_KEY).offset(skip).limit(limit)


def index_config_entities(nodes: DataFrame, edges: DataFrame, entities: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with entities (id, type, title) and links that a configuration extracts (I14); of equal ids the least row."""
    new = one_of(entities.select("id", F.col("type").alias("label"), "title"), "id", last=False)
    return upsert_nodes(nodes, new), upsert_edges(edges, links)


def relationship_texts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (with description) and the text that is embedded for each, by the titles of both ends."""
    s = nodes.select(F.col("id").alias("src"), F.col("title").alias("s"))
    d = nodes.select(F.col("id").alias("dst"), F.col("title").alias("d"))
    named = edges.join(s, "src", "left").join(d, "dst", "left")
    return named.withColumn("text", relationship_text(F.coalesce("s", "src"), F.col("type"), F.coalesce("d", "dst"), F.col("description"))).drop("s", "d")
