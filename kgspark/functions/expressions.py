"""Query expressions over JSON, compiled to columns over variants.

An expression is read once, when a plan is built, and becomes nested column functions; no row runs Python. Forms: fields,
``a.b``, ``[n]``, slices, projections ``[*]``, ``*`` and ``[]`` (flatten), filters ``[?...]``, pipes, ``||``, ``&&``, ``!``,
comparisons, lists and objects of expressions, literals in backquotes (JSON) or single quotes, ``@``, and functions.
Missing values are null; a projection leaves out nulls; functions of a wrong type give null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<quoted>"(?:[^"\\]|\\.)*")|(?P<raw>'(?:[^'\\]|\\.)*')|(?P<literal>`(?:[^`\\]|\\.)*`)|(?P<number>-?\d+)|(?P<sign>\[\?|\[\]|\|\||&&|==|!=|<=|>=|[.*@\[\](){},:|!<>&]))"""
)
#: How tightly what follows an expression binds to it.
_BIND = {"|": 1, "||": 2, "&&": 3, "==": 5, "!=": 5, "<": 5, "<=": 5, ">": 5, ">=": 5, "[]": 9, "[?": 21, ".": 40, "[": 55, "(": 60}
_HERE = ("here",)


class _Reader:
    """Reads an expression by precedence; a node is a tuple of a name and its parts."""

    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unsupported expression {self.text!r} at {at}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0

    def peek(self) -> str:
        kind, value = self.tokens[self.at]
        return value if kind == "sign" else kind

    def take(self, *wanted: str) -> str:
        if wanted and self.peek() not in wanted:
            raise ValueError(f"unsupported expression {self.text!r}: {self.peek()!r} where {' or '.join(wanted)} is due")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        node = self.read(0)
        self.take("end")
        return node

    def read(self, least: int) -> tuple:
        node = self.begin()
        while _BIND.get(self.peek(), 0) > least:
            node = self.go_on(node)
        return node

    def begin(self) -> tuple:
        kind = self.peek()
        value = self.take()
        if kind == "name":
            return ("field", value)
        if kind == "quoted":
            return ("field", json.loads(value))
        if kind == "raw":
            return ("literal", json.dumps(re.sub(r"\\(['\\])", r"\1", value[1:-1])))
        if kind == "literal":
            inner = value[1:-1].replace("\\`", "`")
            try:
                json.loads(inner)
            except ValueError:
                inner = json.dumps(inner.strip())  # a bare word in backquotes is a string
            return ("literal", inner)
        if kind == "@":
            return _HERE
        if kind == "*":
            return ("project", ("values", _HERE), self.rest(20))
        if kind == "!":
            return ("not", self.read(45))
        if kind == "&":
            return ("by", self.read(0))
        if kind == "(":
            node = self.read(0)
            self.take(")")
            return node
        if kind == "{":
            return self.object()
        if kind in ("[]", "[?"):
            return self.bracket(_HERE, kind)
        if kind == "[":
            return self.bracket(_HERE, "[") if self.peek() in ("number", ":", "*") else self.items()
        raise ValueError(f"unsupported expression {self.text!r}: {value!r}")

    def go_on(self, left: tuple) -> tuple:
        sign = self.take()
        if sign == ".":
            if self.peek() == "*":
                self.take()
                return ("project", ("values", left), self.rest(20))
            return ("sub", left, self.after_dot(40))
        if sign == "(":
            if left[0] != "field":
                raise ValueError(f"unsupported expression {self.text!r}: a call of no function")
            args = []
            while self.peek() != ")":
                args.append(self.read(0))
                if self.peek() != ")":
                    self.take(",")
            self.take(")")
            return ("call", left[1], args)
        if sign in ("[", "[]", "[?"):
            return self.bracket(left, sign)
        if sign == "|":
            return ("sub", left, self.read(1))
        return ({"||": "or", "&&": "and"}.get(sign, "compare"), left, self.read(_BIND[sign]), sign)

    def bracket(self, left: tuple, sign: str) -> tuple:
        if sign == "[]":
            return ("project", ("flat", left), self.rest(9))
        if sign == "[?":
            test = self.read(0)
            self.take("]")
            return ("project", ("filter", left, test), self.rest(21))
        if self.peek() == "*":
            self.take()
            self.take("]")
            return ("project", left, self.rest(20))
        parts: list = [None]
        while self.peek() != "]":
            if self.peek() == ":":
                self.take()
                parts.append(None)
            else:
                parts[-1] = int(self.take("number"))
        self.take("]")
        if len(parts) == 1:
            return ("sub", left, ("index", parts[0]))
        return ("project", ("slice", left, *(parts + [None])[:3]), self.rest(20))

    def rest(self, least: int) -> tuple:
        """What is applied to each item of a projection."""
        sign = self.peek()
        if sign == ".":
            self.take()
            return self.after_dot(least)
        return self.read_on(least) if sign in ("[", "[?") else _HERE

    def read_on(self, least: int) -> tuple:
        node = _HERE
        while _BIND.get(self.peek(), 0) > least:
            node = self.go_on(node)
        return node

    def after_dot(self, least: int) -> tuple:
        if self.peek() == "[":
            self.take()
            node = self.items()
        elif self.peek() == "{":
            self.take()
            node = self.object()
        else:
            if self.peek() not in ("name", "quoted", "*"):
                self.take("name", "quoted", "*", "[", "{")
            return self.read(least)
        while _BIND.get(self.peek(), 0) > least:
            node = self.go_on(node)
        return node

    def items(self) -> tuple:
        parts = [self.read(0)]
        while self.take(",", "]") == ",":
            parts.append(self.read(0))
        return ("list", parts)

    def object(self) -> tuple:
        parts = []
        while True:
            kind = self.peek()
            name = self.take("name", "quoted")
            self.take(":")
            parts.append((json.loads(name) if kind == "quoted" else name, self.read(0)))
            if self.take(",", "}") == "}":
                return ("object", parts)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value's expression standing in the plan once."""
    return F.transform(F.array(value), use)[0]


def _text(v: Column) -> Column:
    return F.coalesce(F.to_json(v), F.lit("null"))


def _true(v: Column) -> Column:
    return ~_text(v).isin("null", "false", '""', "[]", "{}")


def _kind(v: Column) -> Column:
    """number, string, boolean, array, object or null."""
    name = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    is_a = lambda *starts: F.greatest(*[F.startswith(name, F.lit(s)) for s in (*starts, *starts)])
    return F.when(is_a("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "number").when(is_a("STRING"), "string").when(is_a("BOOLEAN"), "boolean").when(is_a("ARRAY"), "array").when(is_a("OBJECT"), "object").otherwise("null")


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _number(x: Column) -> Column:
    return _let(x, lambda n: F.when((n == F.floor(n)) & (F.abs(n) < 1e15), n.cast("long").cast("variant")).otherwise(n.cast("variant")))


def _double(v: Column) -> Column:
    return F.when(_kind(v) == "number", F.try_variant_get(v, "$", "double"))


def _string(v: Column) -> Column:
    return F.when(_kind(v) == "string", F.try_variant_get(v, "$", "string"))


def _numbers(v: Column) -> Column:
    """An array of numbers, or null if it holds anything else."""
    return _let(_array(v), lambda a: F.when(F.forall(a, lambda x: _kind(x) == "number"), F.transform(a, lambda x: F.try_variant_get(x, "$", "double"))))


def _variant(x: Column) -> Column:
    return x.cast("variant")


def _sorted(a: Column, by: Callable[[Column], Column]) -> Column:
    """Items by numbers or by texts, equal ones in their order; null if the keys are not all of one kind."""
    keyed = F.transform(a, lambda x, i: F.struct(_double(by(x)).alias("d"), _string(by(x)).alias("s"), i.alias("i"), x.alias("x")))

    def order(k: Column) -> Column:
        one_kind = F.forall(k, lambda e: e["d"].isNotNull()) | F.forall(k, lambda e: e["s"].isNotNull())
        placed = F.array_sort(F.transform(k, lambda e: F.struct(e["d"].alias("d"), e["s"].alias("s"), e["i"].alias("i"))))
        return F.when(one_kind, F.transform(placed, lambda p: F.get(k, p["i"])["x"]))

    return _let(keyed, order)


def _slice(a: Column, start: int | None, stop: int | None, step: int | None) -> Column:
    by = 1 if step is None else step
    if by == 0:
        raise ValueError("a slice with step 0")
    n = F.size(a)

    def bound(x: int | None, default: Column) -> Column:
        if x is None:
            return default
        at = n + x if x < 0 else F.lit(x)
        return F.least(F.greatest(at, F.lit(0 if by > 0 else -1)), n if by > 0 else n - 1)

    low, high = bound(start, F.lit(0) if by > 0 else n - 1), bound(stop, n if by > 0 else F.lit(-1))
    if by > 0:
        return F.filter(a, lambda x, i: (i >= low) & (i < high) & ((i - low) % by == 0))
    back = lambda i: n - 1 - i
    return F.filter(F.reverse(a), lambda x, i: (back(i) <= low) & (back(i) > high) & ((low - back(i)) % -by == 0))


def _call(name: str, args: list[tuple], v: Column) -> Column:
    arg = lambda k: compiled(args[k], v)
    by = lambda k: lambda x: compiled(args[k][1], x)
    listed = lambda a: F.to_variant_object(a)
    first, last = (lambda a: F.try_element_at(a, F.lit(1))), (lambda a: F.try_element_at(a, F.lit(-1)))
    sizes = lambda x: F.when(_kind(x) == "string", F.length(F.try_variant_get(x, "$", "string"))).when(_kind(x) == "object", F.size(F.try_variant_get(x, "$", "map<string,variant>"))).when(_kind(x) == "array", F.size(_array(x)))
    numeric = {"abs": F.abs, "ceil": F.ceil, "floor": F.floor}
    folded = {"sum": lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x), "avg": lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))}
    joined = lambda sep, a: _let(_array(a), lambda xs: F.when(F.forall(xs, lambda x: _kind(x) == "string"), F.call_function("array_join", F.transform(xs, lambda x: F.try_variant_get(x, "$", "string")), sep)))
    holds = lambda s, x: F.when(_kind(s) == "string", F.contains(_string(s), _string(x))).when(_kind(s) == "array", F.exists(_array(s), lambda e: _equal(e, x)))
    forms: dict[str, Callable[[], Column]] = {
        "length": lambda: _variant(_let(arg(0), sizes)),
        "keys": lambda: listed(F.array_sort(F.map_keys(F.try_variant_get(arg(0), "$", "map<string,variant>")))),
        "values": lambda: listed(F.map_values(F.try_variant_get(arg(0), "$", "map<string,variant>"))),
        "type": lambda: _variant(_let(arg(0), _kind)),
        "to_string": lambda: _variant(_let(arg(0), lambda x: F.coalesce(_string(x), _text(x)))),
        "to_number": lambda: _number(F.try_variant_get(arg(0), "$", "double")),
        "to_array": lambda: _let(arg(0), lambda x: F.when(_kind(x) == "array", x).otherwise(listed(F.array(x)))),
        "not_null": lambda: F.coalesce(*[_let(arg(k), lambda x: F.when(_text(x) != "null", x)) for k in range(len(args))]),
        "contains": lambda: _variant(_let(arg(1), lambda x: _let(arg(0), lambda s: holds(s, x)))),
        "starts_with": lambda: _variant(F.startswith(_string(arg(0)), _string(arg(1)))),
        "ends_with": lambda: _variant(F.endswith(_string(arg(0)), _string(arg(1)))),
        "join": lambda: _variant(joined(_string(arg(0)), arg(1))),
        "reverse": lambda: _let(arg(0), lambda x: F.when(_kind(x) == "string", _variant(F.reverse(_string(x)))).otherwise(listed(F.reverse(_array(x))))),
        "sort": lambda: listed(_sorted(_array(arg(0)), lambda x: x)),
        "sort_by": lambda: listed(_sorted(_array(arg(0)), by(1))),
        "min": lambda: first(_sorted(_array(arg(0)), lambda x: x)),
        "max": lambda: last(_sorted(_array(arg(0)), lambda x: x)),
        "min_by": lambda: first(_sorted(_array(arg(0)), by(1))),
        "max_by": lambda: last(_sorted(_array(arg(0)), by(1))),
        "map": lambda: listed(F.transform(_array(arg(1)), by(0))),
        "merge": lambda: _merged([arg(k) for k in range(len(args))]),
    }
    if name in numeric:
        return _number(numeric[name](_let(arg(0), _double)).cast("double"))
    if name in folded:
        return _number(_let(_numbers(arg(0)), folded[name]))
    if name not in forms:
        raise ValueError(f"unsupported function {name!r}")
    return forms[name]()


def _merged(objects: list[Column]) -> Column:
    """Objects' fields together; the later value of a name wins."""
    maps = [F.try_variant_get(o, "$", "map<string,variant>") for o in objects]
    names = F.array_distinct(F.flatten(F.array(*[F.map_keys(m) for m in maps])))
    latest = lambda k: F.coalesce(*[F.try_element_at(m, k) for m in reversed(maps)])
    return F.to_variant_object(F.map_from_arrays(names, F.transform(names, latest)))


def _equal(a: Column, b: Column) -> Column:
    """Whether two values are equal; numbers by value."""
    x, y = _double(a), _double(b)
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(_text(a) == _text(b))


def compiled(node: tuple, v: Column) -> Column:
    """The value of a node for a variant, as a variant."""
    kind = node[0]
    if kind == "here":
        return v
    if kind == "field":
        if re.search(r"['\"\\\]]", node[1]):
            return F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(node[1]))
        return F.try_variant_get(v, f"$['{node[1]}']", "variant")
    if kind == "index":
        return F.try_variant_get(v, f"$[{node[1]}]", "variant") if node[1] >= 0 else F.try_element_at(_array(v), F.lit(node[1]))
    if kind == "literal":
        return F.parse_json(F.lit(node[1]))
    if kind == "sub":
        left = compiled(node[1], v)
        return compiled(node[2], left) if node[2][0] in ("field", "index", "sub", "project") else _let(left, lambda x: compiled(node[2], x))
    if kind == "values":
        return F.to_variant_object(F.map_values(F.try_variant_get(compiled(node[1], v), "$", "map<string,variant>")))
    if kind == "flat":
        return F.to_variant_object(F.flatten(F.transform(_array(compiled(node[1], v)), lambda x: F.coalesce(_array(x), F.array(x)))))
    if kind == "filter":
        return F.to_variant_object(F.filter(_array(compiled(node[1], v)), lambda x: _true(compiled(node[2], x))))
    if kind == "slice":
        return F.to_variant_object(_let(_array(compiled(node[1], v)), lambda a: _slice(a, *node[2:])))
    if kind == "project":
        return F.to_variant_object(F.filter(F.transform(_array(compiled(node[1], v)), lambda x: compiled(node[2], x)), lambda x: _text(x) != "null"))
    if kind == "or":
        return _let(compiled(node[1], v), lambda a: F.when(_true(a), a).otherwise(compiled(node[2], v)))
    if kind == "and":
        return _let(compiled(node[1], v), lambda a: F.when(_true(a), compiled(node[2], v)).otherwise(a))
    if kind == "not":
        return _variant(~_true(compiled(node[1], v)))
    if kind == "compare":
        sign = node[3]

        def both(a: Column, b: Column) -> Column:
            if sign in ("==", "!="):
                return _variant(_equal(a, b) if sign == "==" else ~_equal(a, b))
            x, y = _double(a), _double(b)
            return _variant({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[sign])

        return _let(compiled(node[1], v), lambda a: _let(compiled(node[2], v), lambda b: both(a, b)))
    if kind == "list":
        return F.when(_text(v) != "null", F.to_variant_object(F.array(*[compiled(x, v) for x in node[1]])))
    if kind == "object":
        names = F.array(*[F.lit(n) for n, _ in node[1]])
        return F.when(_text(v) != "null", F.to_variant_object(F.map_from_arrays(names, F.array(*[compiled(x, v) for _, x in node[1]]))))
    if kind == "call":
        return _call(node[1], node[2], v)
    raise ValueError(f"an expression reference stands outside of a function: {node!r}")


def search(raw: Column, expression: str) -> Column:
    """JSON text of what an expression finds in JSON text; null if that is nothing."""
    node = _Reader(expression).whole()
    return F.nullif(F.to_json(_let(F.try_parse_json(raw), lambda v: compiled(node, v))), F.lit("null"))


def transform(raw: Column, fields: dict[str, str]) -> Column:
    """A JSON object of several expressions' results; the text is parsed once."""
    nodes = ("object", [(k, _Reader(e).whole()) for k, e in fields.items()])
    return F.to_json(_let(F.coalesce(F.try_parse_json(raw), F.parse_json(F.lit("{}"))), lambda v: compiled(nodes, v)))
