"""Expressions over JSON against values written down by hand."""

import json

import pytest
from pyspark.sql import functions as F

from kgspark.functions import expressions as E

DATA = {
    "blocks": [{"id": 1, "type": "p", "text": "one", "n": 3}, {"id": 2, "type": "h", "text": "two", "n": 1.5}, {"id": 3, "type": "p", "text": None, "tags": ["x", "y"]}, {"id": 4, "type": "p", "tags": ["z"]}],
    "empty": [], "name": "Ada", "none": None, "zero": 0, "yes": True, "no": False, "nested": [[1, 2], [3, [4]], 5], "o": {"b": 2, "a": {"k": "v"}, "c": None}, "odd key": {"it's": 1}, "s": "", "nums": [3, 1, 2], "words": ["b", "a"],
}

CASES = [
    ("name", "Ada"), ("o.a.k", "v"), ("none", None), ("missing.deep", None), ("blocks[0].text", "one"), ("blocks[-1].id", 4), ("blocks[9]", None), ('"odd key"', {"it's": 1}), ('"odd key"."it\'s"', 1),
    ("blocks.length", None), ("blocks && length(blocks) > `0`", True), ("empty && length(empty) > `0`", []), ("blocks && blocks.length > `0`", None), ("blocks[0:3].id", [1, 2, 3]), ("blocks[::2].id", [1, 3]), ("blocks[::-1].id", [4, 3, 2, 1]), ("blocks[-2:].id", [3, 4]),
    ("nums[2:0:-1]", [2, 1]), ("blocks[*].text", ["one", "two"]), ("blocks[*].tags", [["x", "y"], ["z"]]), ("blocks[].tags[]", ["x", "y", "z"]), ("blocks[*].tags[0]", ["x", "z"]), ("blocks[*].tags | [0]", ["x", "y"]), ("nested[]", [1, 2, 3, [4], 5]), ("nested[][]", [1, 2, 3, 4, 5]),
    ("blocks[?type == 'p'].id", [1, 3, 4]), ("blocks[?type == 'p' && n].id", [1]), ("blocks[?n > `1.5` || type == `h`].id", [1, 2]), ("blocks[?!text].id", [3, 4]), ("blocks[?!(type == 'p' || n == `1`)].id", [2]), ("blocks[?n == `1.50`].id", [2]), ("blocks[?contains(tags, 'y')].id | [0]", 3),
    ("o.*", [{"k": "v"}, 2]), ("*.k", []), ("o.*.k", ["v"]), ("[name, zero, none]", ["Ada", 0, None]), ("{who: name, n: length(blocks), inner: {t: blocks[0].type}}", {"who": "Ada", "n": 4, "inner": {"t": "p"}}), ("blocks[*].{i: id, t: type} | [1]", {"i": 2, "t": "h"}), ("blocks[*].[id, type] | [0]", [1, "p"]),
    ("missing || name", "Ada"), ("s || no || 'last'", "last"), ("yes && name", "Ada"), ("zero && name", "Ada"), ("!yes", False), ("!missing", True), ("name == 'Ada'", True), ("name != 'Ada'", False), ("name < 'B'", None), ("zero <= `0`", True), ("`[1, 2]`", [1, 2]), ("'it\\'s'", "it's"), ("@.name", "Ada"), ("(blocks[*].id)[0]", 1),
    ("sum(nums)", 6), ("avg(nums)", 2), ("max(nums)", 3), ("min(words)", "a"), ("sort(nums)", [1, 2, 3]), ("sort(words)", ["a", "b"]), ("reverse(nums)", [2, 1, 3]), ("reverse(name)", "adA"), ("join('-', words)", "b-a"), ("keys(o)", ["a", "b", "c"]), ("values(\"odd key\")", [1]), ("length(name)", 3), ("length(zero)", None), ("type(blocks)", "array"), ("type(none)", "null"),
    ("to_string(nums)", "[3,1,2]"), ("to_string(name)", "Ada"), ("to_number('2.5')", 2.5), ("to_array(zero)", [0]), ("not_null(none, missing, zero)", 0), ("starts_with(name, 'A')", True), ("ends_with(name, 'A')", False), ("contains(name, 'd')", True), ("abs(`-2`)", 2), ("ceil(`1.2`)", 2), ("floor(`1.8`)", 1),
    ("sort_by(blocks[?n], &n)[*].id", [2, 1]), ("max_by(blocks[?n], &n).id", 1), ("min_by(blocks[?n], &n).id", 2), ("map(&id, blocks)", [1, 2, 3, 4]), ("merge(o, `{\"b\": 9}`).b", 9), ("avg(empty)", None), ("sum(words)", None), ("sort(`[1, \"a\"]`)", None),
]


def test_expressions(spark):
    found = {}
    for k in range(0, len(CASES), 20):
        df = spark.createDataFrame([(json.dumps(DATA),)], "raw string").select(*[E.search(F.col("raw"), e).alias(f"c{k + i}") for i, (e, _) in enumerate(CASES[k : k + 20])])
        found |= df.first().asDict()
    wrong = [(e, want, found[f"c{i}"]) for i, (e, want) in enumerate(CASES) if (None if found[f"c{i}"] is None else json.loads(found[f"c{i}"])) != want]
    assert not wrong


def test_transform_and_bad_json(spark):
    df = spark.createDataFrame([(1, json.dumps(DATA)), (2, "{"), (3, None), (4, "[]")], "i int, raw string")
    got = {r.i: r.t for r in df.select("i", E.transform(F.col("raw"), {"n": "length(blocks)", "has": "blocks && length(blocks) > `0`"}).alias("t")).collect()}
    assert json.loads(got[1]) == {"n": 4, "has": True} and json.loads(got[2]) == json.loads(got[3]) == json.loads(got[4]) == {"n": None, "has": None}
    assert [r[0] for r in df.select(E.search(F.col("raw"), "name")).collect()] == ['"Ada"', None, None, None]


@pytest.mark.parametrize("text", ["a b", "a.", "[", "a[?b", "foo(a)", "{a}", "a ==", "a[1", "&a", "'x", "a[::0]"])
def test_refused(spark, text):
    with pytest.raises(ValueError):
        E.search(F.col("raw"), text)
