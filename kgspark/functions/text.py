"""Column functions over names and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that JavaScript's \s matches, for parity with trim(); fixed values.
JS_SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: Entity type that a relationship's far end has; fixed values.
TYPE_BY_RELATIONSHIP = {
    "MEMBER_OF": "Organization",
    "PART_OF": "Organization",
    "WORKS_ON": "Project",
    "ASSIGNED_TO": "Task",
    "REPORTS_TO": "Person",
    "MANAGES": "Person",
    "CREATED_BY": "Person",
    "APPROVED_BY": "Person",
    "REVIEWED_BY": "Person",
}
#: Relationship types that say no more than nearness; fixed values.
GENERIC_RELATIONSHIPS = ["MENTIONED_WITH", "APPEARS_WITH", "RELATED_TO", "SIMILAR_TO", "ASSOCIATED_WITH"]
#: Types whose entities stay without any relationship; fixed values.
HIGH_VALUE_TYPES = ["PERSON", "ORGANIZATION", "COMPANY", "LOCATION", "PRODUCT", "PROJECT"]
#: Programs and file endings by which commands and paths are told; fixed values.
COMMANDS = "npm|pnpm|npx|yarn|node|tsx|ts-node|deno|git|docker|kubectl|brew|cargo|rustc|cd|ls|cp|mv|rm|mkdir|cat|grep|sed|awk"
FILE_ENDINGS = "ts|js|tsx|jsx|py|java|go|rs|c|cpp|h|md|json|yaml|yml|xml|html|css|scss"
#: Reserved words of the graph language; fixed values.
RESERVED = (
    "MATCH WHERE RETURN CREATE DELETE SET REMOVE MERGE WITH UNWIND CASE WHEN THEN ELSE END AND OR XOR NOT IN STARTS ENDS CONTAINS IS NULL TRUE FALSE "
    "DISTINCT AS ORDER BY SKIP LIMIT ASC DESC ON INDEX DROP CONSTRAINT ASSERT UNIQUE EXISTS CALL YIELD"
).split()


def trim(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"^{JS_SPACE}+|{JS_SPACE}+$", "")


def let(c: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it; keeps deep expressions linear in size."""
    return F.element_at(F.transform(F.array(c), f), 1)


def truthy(c: Column) -> Column:
    """A text that counts as given: neither null nor empty."""
    return c.isNotNull() & (c != "")


def normalize_name(c: Column) -> Column:
    """Lookup form of a name (H1): lower case, trimmed, inner white space collapsed."""
    return F.regexp_replace(trim(F.lower(c)), rf"{JS_SPACE}+", " ")


def id_name(c: Column) -> Column:
    """Form of a name inside ids (H1): lower case and trimmed only."""
    return trim(F.lower(c))


def strip_quotes(c: Column) -> Column:
    """Trim and drop straight quotes and backticks anywhere (H3); curly quotes stay."""
    return trim(F.translate(F.regexp_replace(trim(c), r'\\"', ""), "\"'`", ""))


def is_command(c: Column) -> Column:
    return c.rlike(rf"(?i)^({COMMANDS})\s") | c.rlike(r"--[\w-]+=") | c.rlike(r"^\w+\s+\w+\s+--")


def command_name(c: Column) -> Column:
    """The script a command runs, or its first three words that are not flags."""
    script = F.regexp_replace(F.regexp_extract(c, r"scripts?/([^/\s]+)", 1), r"(?i)\.(ts|js|tsx|jsx)$", "")
    words = F.filter(F.split(c, " "), lambda w: ~F.startswith(w, F.lit("--")) & (trim(w) != ""))
    return let(script, lambda x: F.when(x != "", x).otherwise(F.array_join(F.slice(words, 1, 3), " ")))


def is_path(c: Column) -> Column:
    return c.rlike(r"^[\w.-]+/[\w./-]+$") | c.rlike(r"(?i)^[a-z]:\\") | c.rlike(rf"(?i)\.({FILE_ENDINGS})$")


def sanitize_name(c: Column) -> Column:
    """An entity's clean name, or null if it is no name (H4)."""

    def without_command(clean: Column) -> Column:
        return let(command_name(clean), lambda n: F.when(is_command(clean), F.when(F.length(n) <= 100, n)).otherwise(clean))

    def without_path(named: Column) -> Column:
        return F.when(is_path(named), F.element_at(F.split(named, r"[/\\]"), -1)).otherwise(named)

    def plausible(named: Column) -> Column:
        special = F.length(F.regexp_replace(named, r"[a-zA-Z0-9\s_-]", ""))
        return F.when((F.length(named) > 150) | (special > 0.3 * F.length(named)), None).otherwise(named)

    clean = let(strip_quotes(c), lambda x: F.nullif(x, F.lit("")))
    return let(let(let(clean, without_command), without_path), plausible)


def type_from_relationship(c: Column) -> Column:
    """Entity type that a relationship type suggests (H5)."""
    out = F.lit("Entity")
    for k, v in TYPE_BY_RELATIONSHIP.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def sanitize_identifier(c: Column, upper: bool = False, prefix: str = "_") -> Column:
    """A safe identifier, or null if nothing is left (H6)."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9_]", "_"), "_+", "_"), "^_+|_+$", "")
    s = let(s, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lit(prefix), x)).when(x != "", x))
    return F.upper(s) if upper else s


def sanitize_relationship_type(c: Column) -> Column:
    return sanitize_identifier(c, upper=True)


def needs_escaping(c: Column) -> Column:
    """Whether an identifier must be quoted (H7)."""
    return c.isNull() | (c == "") | c.rlike("[^a-zA-Z0-9_]") | c.rlike("^[0-9]") | F.upper(c).isin(RESERVED)


def escape_identifier(c: Column) -> Column:
    return F.when(needs_escaping(c), F.concat(F.lit("`"), F.replace(c, F.lit("`"), F.lit("``")), F.lit("`"))).otherwise(c)


def unescape_identifier(c: Column) -> Column:
    inner = F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit("``"), F.lit("`"))
    return F.when(F.startswith(c, F.lit("`")) & F.endswith(c, F.lit("`")) & (F.length(c) >= 2), inner).otherwise(c)


def capitalize_first(c: Column) -> Column:
    """Upper-case the first character only."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def entity_text(kind: Column, name: Column, description: Column) -> Column:
    """What is embedded for an entity (H9)."""
    return F.concat(kind, F.lit(" - "), name, F.when(truthy(description), F.concat(F.lit("\n"), description)).otherwise(""))


def relationship_text(source: Column, kind: Column, target: Column, description: Column) -> Column:
    """What is embedded for a relationship (H9); a missing end is Unknown."""
    unknown = F.lit("Unknown")
    head = F.concat(F.coalesce(source, unknown), F.lit(" -["), kind, F.lit("]-> "), F.coalesce(target, unknown))
    return F.concat(head, F.when(truthy(description), F.concat(F.lit("\n"), description)).otherwise(""))


def content_text(record_id: Column, title: Column, content: Column) -> Column:
    """What is chunked of a record."""
    return F.concat(F.lit("ID: "), record_id, F.lit("\n# "), F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(content, F.lit("")))


def snippet(c: Column, length: int = 500) -> Column:
    return F.substring(c, 1, length)


def estimate_tokens(c: Column) -> Column:
    """A quarter of the length, rounded up."""
    return F.ceil(F.length(c) / 4)


def normalize_text(c: Column) -> Column:
    """Lower case, punctuation to spaces, white space collapsed."""
    # Every mark and kind of white space becomes a space, so that the pattern only has to find runs of spaces.
    blank = ".,;:!?()[]{}'\"\t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
    return F.trim(F.regexp_replace(F.translate(F.lower(c), blank, " " * len(blank)), " {2,}", " "))


def item_matched(response: Column, item: Column) -> Column:
    """Whether a required item is in a response: as a whole, or at least 70 % of its words over two letters."""
    r, i = normalize_text(response), normalize_text(item)
    words = F.filter(F.split(i, " "), lambda w: F.length(w) > 2)
    have = F.split(r, " ")
    found = F.size(F.filter(words, lambda w: F.array_contains(have, w)))
    return F.contains(r, i) | ((F.size(words) > 0) & (found >= 0.7 * F.size(words)))


def semantic_score(response: Column, items: Column) -> Column:
    """Jaccard similarity of a response's tokens and the items' tokens over two letters; 1 without any."""
    have = F.array_distinct(F.split(normalize_text(response), " "))
    want = F.array_distinct(F.filter(F.flatten(F.transform(items, lambda x: F.split(normalize_text(x), " "))), lambda w: F.length(w) > 2))
    return F.when(F.size(want) == 0, 1.0).otherwise(F.size(F.array_intersect(want, have)) / F.size(F.array_union(want, have)))


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' lower-case tokens."""
    x, y = (F.array_distinct(F.split(trim(F.lower(c)), rf"{JS_SPACE}+")) for c in (a, b))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def references(c: Column, pattern: str, group: int = 1) -> Column:
    """Distinct matches of a pattern's group, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)))


ISSUE_REFERENCE = r"#(\d+)"
PULL_REFERENCE = r"(?i)(?:PR|pull request)\s*#?(\d+)"
PAGE_REFERENCE = r"notion\.so/(\d+)"


def first_contained(c: Column, phrases: list[str]) -> Column:
    """The first of some phrases that a text contains, or null."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(p)), p) for p in phrases])
