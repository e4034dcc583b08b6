"""Markup of several kinds to Markdown."""

from __future__ import annotations

import html as _html
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def markup(c: Column, rules: list[tuple[str, str]] | None = None, users: dict[str, str] | None = None) -> Column:
    """Chat markup to Markdown by ordered rules (H15): mentions, channels, links, bold, italic, strike."""
    if rules is None:
        for user, name in (users or {}).items():
            c = F.replace(c, F.lit(f"<@{user}>"), F.lit(name))
        rules = [
            (r"<@(\w+)>", "@$1"),
            (r"<#\w+\|([^>]+)>", "#$1"),
            (r"<([^|>]+)\|([^>]+)>", "[$2]($1)"),
            (r"<([^>]+)>", "$1"),
            (r"\*([^*]+)\*", "**$1**"),
            (r"_([^_]+)_", "*$1*"),
            (r"~([^~]+)~", "~~$1~~"),
        ]
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


RICH = "array<struct<plain_text:string,href:string,text:struct<content:string>,annotations:struct<bold:boolean,italic:boolean,code:boolean,strikethrough:boolean,underline:boolean>>>"


def rich_text(c: Column) -> Column:
    """Rich-text blocks (array of structs, or their JSON) to Markdown."""

    def one(b):
        text = F.coalesce(F.nullif(b["text"]["content"], F.lit("")), b["plain_text"], F.lit(""))
        for name, left, right in (("bold", "**", "**"), ("italic", "*", "*"), ("code", "`", "`"), ("strikethrough", "~~", "~~"), ("underline", "<u>", "</u>")):
            text = F.when(F.coalesce(b["annotations"][name], F.lit(False)), F.concat(F.lit(left), text, F.lit(right))).otherwise(text)
        return F.when(F.coalesce(b["href"], F.lit("")) != "", F.concat(F.lit("["), text, F.lit("]("), b["href"], F.lit(")"))).otherwise(text)

    return F.array_join(F.transform(c, one), "")


def transcript(c: Column, milliseconds: bool = False) -> Column:
    """Segments (speaker, text, start_time) to Markdown."""

    def one(s):
        t = s["start_time"] / (1000 if milliseconds else 1)
        time = F.concat(F.lit("["), F.floor(t / 60).cast("string"), F.lit(":"), F.lpad(F.floor(t % 60).cast("string"), 2, "0"), F.lit("]"))
        return F.concat(F.when(s["start_time"].isNotNull(), time).otherwise(""), F.lit(" **"), F.coalesce(F.nullif(s["speaker"], F.lit("")), F.lit("Unknown")), F.lit("**: "), F.coalesce(s["text"], F.lit("")))

    return F.array_join(F.transform(c, one), "\n\n")


def extract_text(c: Column) -> Column:
    """Text of JSON: a string itself, an object's text field, an array's texts by line, else the JSON."""
    v = F.try_parse_json(c)
    kind = F.schema_of_variant(v)
    field = F.coalesce(F.try_variant_get(v, "$.text", "string"), F.try_variant_get(v, "$.content", "string"))
    items = F.from_json(c, "array<variant>")
    lines = F.array_join(F.transform(items, lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.try_variant_get(x, "$", "string"))), "\n")
    return F.when(v.isNull(), c).when(kind == "STRING", F.variant_get(v, "$", "string")).when(F.startswith(kind, F.lit("ARRAY")), lines).otherwise(F.coalesce(field, c))


class _Markdown(HTMLParser):
    """A page's visible text with headings, links, lists, emphasis and code."""

    SKIP = {"script", "style", "head", "noscript", "template"}
    MARK = {"b": "**", "strong": "**", "i": "_", "em": "_", "code": "`", "del": "~~"}
    BLOCK = {"p", "div", "section", "article", "header", "footer", "nav", "main", "table", "tr", "ul", "ol", "blockquote", "pre", "aside", "form"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skipped: list[str] = []
        self.links: list[str] = []
        self.lists: list[list] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skipped.append(tag)
        if self.skipped:
            return
        if re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in self.MARK:
            self.out.append(self.MARK[tag])
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "li":
            if self.lists and self.lists[-1][0] == "ol":
                self.lists[-1][1] += 1
                self.out.append(f"\n{self.lists[-1][1]}. ")
            else:
                self.out.append("\n- ")
        elif tag in self.BLOCK:
            if tag in ("ul", "ol"):
                self.lists.append([tag, 0])
            self.out.append("\n\n" + ("> " if tag == "blockquote" else ""))

    def handle_endtag(self, tag):
        if self.skipped:
            if tag == self.skipped[-1]:
                self.skipped.pop()
            return
        if re.fullmatch("h[1-6]", tag) or tag in self.BLOCK:
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            self.out.append("\n\n")
        elif tag in self.MARK:
            self.out.append(self.MARK[tag])
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")

    def handle_data(self, data):
        if not self.skipped:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_markdown(page: str | None) -> str | None:
    """One page's Markdown (H17); a small helper of the UDF."""
    if page is None:
        return None
    parser = _Markdown()
    parser.feed(page)
    parser.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(parser.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


BULLETS = {"bulleted_list_item": "- ", "numbered_list_item": "1. ", "quote": "> ", "heading_1": "# ", "heading_2": "## ", "heading_3": "### ", "toggle": "> ", "callout": "> "}


def blocks_to_markdown(blocks: str | None) -> str | None:
    """JSON list of content blocks to Markdown (H14), nested ones indented."""
    if blocks is None:
        return None

    def text(b: dict) -> str:
        body = b.get(b.get("type", ""), {}) or {}
        return "".join((r.get("text") or {}).get("content") or r.get("plain_text") or "" for r in body.get("rich_text") or body.get("text") or [])

    def lines(items: list, depth: int) -> Iterator[str]:
        for b in items:
            kind, body = b.get("type", ""), b.get(b.get("type", ""), {}) or {}
            said = text(b)
            if kind == "code":
                said = f"```{body.get('language', '')}\n{said}\n```"
            elif kind == "to_do":
                said = f"- [{'x' if body.get('checked') else ' '}] {said}"
            elif kind == "divider":
                said = "---"
            elif kind == "child_page":
                said = f"[{body.get('title', '')}]"
            elif kind == "image":
                said = f"![image]({(body.get('external') or body.get('file') or {}).get('url', '')})"
            else:
                said = BULLETS.get(kind, "") + said
            if said:
                yield "  " * depth + said
            yield from lines(b.get("children") or body.get("children") or [], depth + 1)

    try:
        parsed = json.loads(blocks)
    except ValueError:
        return ""
    return "\n\n".join(lines(parsed if isinstance(parsed, list) else [parsed], 0))


@F.pandas_udf(StringType())
def html_markdown(pages: pd.Series) -> pd.Series:
    return pages.map(html_to_markdown)


@F.pandas_udf(StringType())
def blocks_markdown(blocks: pd.Series) -> pd.Series:
    return blocks.map(blocks_to_markdown)


#: Named processors of the mapping compiler.
PROCESSORS: dict[str, Callable[[Column], Column]] = {
    "rich-text-to-markdown": lambda c: rich_text(F.from_json(c, RICH)),
    "blocks-to-markdown": lambda c: blocks_markdown(c),
    "markup-to-markdown": markup,
    "transcript-to-markdown": lambda c: transcript(F.from_json(c, "array<struct<speaker:string,text:string,start_time:double>>")),
    "html-to-markdown": lambda c: html_markdown(c),
    "extract-text": extract_text,
}


def register_processor(name: str, function: Callable[[Column], Column]) -> None:
    PROCESSORS[name] = function


def unescape(text: str) -> str:
    return _html.unescape(text)
