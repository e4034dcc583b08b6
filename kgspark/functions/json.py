"""JSON access: paths compiled to columns, mapping forms, conditions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgspark.functions.expressions import search, transform
from kgspark.functions.text import truthy

__all__ = ["condition", "parameters", "paths", "search", "steps", "template", "transform", "value", "values"]

_STEP = re.compile(r"\.([A-Za-z_][\w-]*)|\[(\d+)\]|\['([^']+)'\]|\[(\*)\]")


def steps(path: str) -> list[str | int]:
    """Names, places and stars of a path like ``$.a.b[0]['c'][*]``; anything else is refused."""
    body = path[1:] if path.startswith("$") else ("." + path if path and path[0] not in ".[" else path)
    out: list[str | int] = []
    at = 0
    while at < len(body):
        m = _STEP.match(body, at)
        if not m:
            raise ValueError(f"unsupported path {path!r}")
        name, place, quoted, star = m.groups()
        out.append(int(place) if place else "*" if star else name or quoted)
        at = m.end()
    return out


def value(raw: Column, path: str) -> Column:
    """First match of a path in JSON text, as text."""
    s = steps(path)
    inner = "".join(f"[{x}]" if isinstance(x, int) else "[0]" if x == "*" else f"['{x}']" if not re.fullmatch(r"\w+", x) else f".{x}" for x in s)
    return F.get_json_object(raw, "$" + inner)


def values(raw: Column, path: str) -> Column:
    """All matches of a path with at most one ``[*]``, as texts."""
    s = steps(path)
    if "*" not in s:
        v = value(raw, path)
        return F.when(v.isNotNull(), F.array(v)).otherwise(F.array().cast("array<string>"))
    k = s.index("*")
    show = lambda part: "$" + "".join(f"[{x}]" if isinstance(x, int) else f".{x}" for x in part)
    head, tail = s[:k], s[k + 1 :]
    items = F.from_json(F.get_json_object(raw, show(head)), "array<variant>")
    picked = F.transform(items, lambda x: F.try_variant_get(x, show(tail), "string") if tail else F.try_variant_get(x, "$", "string"))
    return F.coalesce(F.filter(picked, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def paths(raw: Column, wanted: list[str], separator: str = " ") -> Column:
    """Values of several paths that are not empty, joined; null if none is."""
    return F.nullif(F.array_join(F.filter(F.array(*[value(raw, p) for p in wanted]), lambda x: truthy(x)), separator), F.lit(""))


def template(raw: Column, text: str) -> Column:
    """A text with ``${path}`` filled in; a missing value is empty."""
    parts = re.split(r"\$\{([^}]+)\}", text)
    cols = [F.coalesce(value(raw, p.strip()), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p]
    return F.concat(*cols) if cols else F.lit("")


def _node(value: Column, path: str) -> Column:
    """What a plain path leads to in a variant."""
    inner = "".join(f"[{x}]" if isinstance(x, int) else f"['{x}']" for x in steps(path) if path)
    return F.try_variant_get(value, "$" + inner, "variant") if path not in ("", "@") else value


def parameters(parent: Column, fixed: dict, from_parent: dict[str, str]) -> Column:
    """A JSON object of a nested call's parameters (H28): fixed ones, then ``$parent.a.b`` of the parent's JSON, other ``$``-free texts as they are."""
    parts = {k: F.lit(json.dumps(v)) for k, v in fixed.items()}
    for k, v in from_parent.items():
        if v.startswith("$parent."):
            parts[k] = F.coalesce(F.to_json(_node(F.try_parse_json(parent), v.removeprefix("$parent."))), F.lit("null"))
        elif v.startswith("$"):
            raise ValueError(f"unsupported parameter {v!r}")
        else:
            parts[k] = F.lit(json.dumps(v))
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f"{json.dumps(k)}:"), c) for k, c in parts.items()]), F.lit("}"))


def condition(raw: Column, text: str) -> Column:
    """A predicate of member access, comparisons, ``&&``, ``||``, ``!``, brackets, ``.length``, ``startsWith`` and ``includes`` (L3).

    It is translated, never executed; anything else is refused.
    """
    text = text.strip()
    for sign, join in (("||", lambda a, b: a | b), ("&&", lambda a, b: a & b)):
        parts = _split(text, sign)
        if len(parts) > 1:
            out = condition(raw, parts[0])
            for p in parts[1:]:
                out = join(out, condition(raw, p))
            return out
    if m := re.match(r"(!*)\s*\(", text):
        if _closes(text, m.end() - 1) == len(text) - 1:
            inner = condition(raw, text[m.end() : -1])
            return ~inner if len(m[1]) % 2 else inner
    if m := re.fullmatch(r"(!*)\s*(?:record\.)?([\w.\[\]]+)\.(startsWith|includes)\((['\"])(.*)\4\)", text):
        c, arg = value(raw, m[2]), F.lit(m[5])
        out = F.coalesce(F.startswith(c, arg) if m[3] == "startsWith" else F.contains(c, arg), F.lit(False))
        return ~out if len(m[1]) % 2 else out
    if m := re.fullmatch(r"(?:record\.)?([\w.\[\]]+?)(\.length)?\s*(===|!==|==|!=|>=|<=|>|<)\s*(.+)", text):
        c = value(raw, m[1])
        right = m[4].strip()
        if m[2]:
            c = F.coalesce(F.json_array_length(c), F.length(c))
        if right in ("null", "undefined"):
            return c.isNull() if m[3] in ("==", "===") else c.isNotNull()
        if q := re.fullmatch(r"(['\"])(.*)\1", right):
            other = F.lit(q[2])
        elif right in ("true", "false"):
            other = F.lit(right)
        elif re.fullmatch(r"-?\d+(\.\d+)?", right):
            c, other = c.cast("double"), F.lit(float(right))
        else:
            raise ValueError(f"unsupported condition {text!r}")
        ops: dict[str, Callable] = {"=": lambda: c == other, "!": lambda: c != other, ">=": lambda: c >= other, "<=": lambda: c <= other, ">": lambda: c > other, "<": lambda: c < other}
        key = m[3] if m[3] in (">=", "<=", ">", "<") else m[3][0]
        return F.coalesce(ops[key](), F.lit(key == "!"))
    if m := re.fullmatch(r"(!*)\s*(?:record\.)?([\w.\[\]]+)", text):
        c = value(raw, m[2])
        out = truthy(c) & ~c.isin("false", "0")
        out = F.coalesce(out, F.lit(False))
        return ~out if len(m[1]) % 2 else out
    raise ValueError(f"unsupported condition {text!r}")


def _closes(text: str, at: int) -> int:
    """Where the bracket at a place is closed; quoted brackets do not count."""
    depth, quote = 0, ""
    for i in range(at, len(text)):
        ch = text[i]
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
            if not depth:
                return i
    return -1


def _split(text: str, sign: str) -> list[str]:
    """Parts between a sign that stands outside quotes and brackets."""
    out, depth, quote, start, i = [], 0, "", 0, 0
    while i < len(text):
        ch = text[i]
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif not depth and text.startswith(sign, i):
            out.append(text[start:i])
            start = i + len(sign)
            i = start
            continue
        i += 1
    return [*out, text[start:]]
