"""Column functions on literal cases."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from kgspark.functions import dates as D
from kgspark.functions import ids as I
from kgspark.functions import json as J
from kgspark.functions import markup as M
from kgspark.functions import text as T


def one(spark, *columns, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x int"
    rows = [tuple(values.values())] if values else [(0,)]
    return spark.createDataFrame(rows, schema).select(*columns).first()


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ('  "Acme" ', "Acme"),
        ("npm install react native now", "npm install react"),
        ("pnpm tsx scripts/shadowComparison/index.ts", "shadowComparison"),
        ("src/utils/text.py", "text.py"),
        ("C:\\work\\a.txt", "a.txt"),
        ("!!!???###", None),
        ("", None),
        ("   ", None),
        (None, None),
        ("x" * 151, None),
        ("x" * 150, "x" * 150),
        ("\u201cquoted\u201d name here", "\u201cquoted\u201d name here"),
    ],
)
def test_sanitize_name(spark, given, want):
    assert one(spark, T.sanitize_name(F.col("a")), a=given)[0] == want


def test_curly_quotes_survive(spark):
    assert one(spark, T.strip_quotes(F.col("a")), a="\u201cx\u201d 'y' `z`")[0] == "\u201cx\u201d y z"


@pytest.mark.parametrize(("given", "want"), [("MEMBER_OF", "Organization"), ("REPORTS_TO", "Person"), ("WORKS_ON", "Project"), ("ANYTHING", "Entity")])
def test_type_from_relationship(spark, given, want):
    assert one(spark, T.type_from_relationship(F.col("a")), a=given)[0] == want


@pytest.mark.parametrize(("given", "want"), [("works-on?", "WORKS_ON"), ("3d", "_3D"), ("___", None), ("", None), (None, None), ("a  b", "A_B")])
def test_relationship_type(spark, given, want):
    assert one(spark, T.sanitize_relationship_type(F.col("a")), a=given)[0] == want


@pytest.mark.parametrize(("given", "want"), [("match", "`match`"), ("a`b", "`a``b`"), ("ok_1", "ok_1"), ("1a", "`1a`"), ("", "``")])
def test_escape(spark, given, want):
    out = one(spark, T.escape_identifier(F.col("a")).alias("e"), T.unescape_identifier(T.escape_identifier(F.col("a"))), a=given)
    assert out[0] == want and out[1] == given


def test_two_name_forms(spark):
    r = one(spark, T.normalize_name(F.col("a")), T.id_name(F.col("a")), a=" A \u00a0 B ")
    assert r[0] == "a b" and r[1] == "a \u00a0 b"


def test_ids(spark):
    a, b, c = one(spark, I.entity_id(F.lit("Person"), F.col("a")), I.entity_id(F.lit("Person"), F.lit("ann")), I.relationship_id(F.lit("x"), F.lit("T"), F.lit("y")), a=" Ann ")
    assert a == b and [len(p) for p in c.split("-")] == [8, 4, 4, 4, 12]


def test_matching(spark):
    r = one(spark, T.item_matched(F.col("a"), F.lit("quick brown fox jumps")), T.item_matched(F.col("a"), F.lit("slow brown cats")), T.semantic_score(F.col("a"), F.array(F.lit("quick fox"), F.lit("of"))), a="The QUICK, brown (fox)!")
    assert r[0] is True and r[1] is False and r[2] == pytest.approx(2 / 4)


def test_markup(spark):
    r = one(spark, M.markup(F.col("a")), M.markup(F.col("a"), users={"U1": "Ann"}), M.markup(F.col("a"), [(r"\*", "!")]), a="*b* _i_ ~s~ <@U1> <#C1|gen> <http://x|t>")
    assert r[0] == "**b** *i* ~~s~~ @U1 #gen [t](http://x)" and "Ann" in r[1] and r[2].startswith("!b!")


def test_html_and_blocks():
    page = "<html><head><title>x</title></head><body><h2>Hi &amp; ho</h2><p>a <b>b</b> <a href='u'>c</a></p><ol><li>1<li>2</ol><script>no</script></body></html>"
    assert M.html_to_markdown(page) == "## Hi & ho\n\na **b** [c](u)\n\n1. 1\n2. 2"
    assert M.html_to_markdown(None) is None and M.html_to_markdown("") == ""
    blocks = [{"type": "heading_1", "heading_1": {"rich_text": [{"plain_text": "T"}]}}, {"type": "to_do", "to_do": {"checked": True, "rich_text": [{"text": {"content": "x"}}]}, "children": [{"type": "code", "code": {"language": "py", "rich_text": [{"plain_text": "1"}]}}]}]
    assert M.blocks_to_markdown(json.dumps(blocks)) == "# T\n\n- [x] x\n\n  ```py\n1\n```"
    assert M.blocks_to_markdown("not json") == ""


def test_extract_text(spark):
    got = [one(spark, M.extract_text(F.col("a")), a=x)[0] for x in ('"s"', '{"text": "t"}', '[{"text": "a"}, {"text": "b"}]', '{"z": 1}', "plain")]
    assert got == ["s", "t", "a\nb", '{"z": 1}', "plain"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("record.a === 'x'", True), ("a != 'x'", False), ("a === 'x' && n > 3", True), ("missing || flag", True), ("!missing", True), ("s.startsWith('he')", True), ("!s.includes('zz')", True), ("list.length >= 2", True), ("missing === null", True), ("(n < 3) || !flag", False)],
)
def test_conditions(spark, text, want):
    raw = json.dumps({"a": "x", "n": 5, "flag": True, "s": "hello", "list": [1, 2]})
    assert one(spark, J.condition(F.col("a"), text), a=raw)[0] is want


def test_code_is_refused():
    for bad in ("process.exit()", "a = 1", "fetch('x')", "a > b"):
        with pytest.raises(ValueError):
            J.condition(F.lit("{}"), bad)
    with pytest.raises(ValueError):
        J.steps("$.a[?(@.b)]")


def test_json_paths(spark):
    raw = json.dumps({"a": {"b": [{"c": 1}, {"d": 2}, {"c": 3}]}, "e f": "g", "n": None})
    r = one(spark, J.values(F.col("a"), "a.b[*].c"), J.value(F.col("a"), "$.a.b[2].c"), J.value(F.col("a"), "$['e f']"), J.paths(F.col("a"), ["n", "q"]), J.template(F.col("a"), "<${a.b[0].c}${q}>"), a=raw)
    assert r[0] == ["1", "3"] and r[1] == "3" and r[2] == "g" and r[3] is None and r[4] == "<1>"


def test_dates(spark):
    now = F.lit(datetime.datetime(2024, 1, 2))
    r = one(spark, *[D.relative_time(F.lit(datetime.datetime(2024, 1, 2) - datetime.timedelta(seconds=s)), now) for s in (5, 60, 7200, 200000)], D.coerce(F.lit("never")), D.half_up(F.lit(7.5)))
    assert list(r) == ["just now", "1 minute ago", "2 hours ago", "2 days ago", None, 8]
