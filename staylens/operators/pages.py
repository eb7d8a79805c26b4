"""Saved web pages to review rows and hotel links, and file-path parsing.

Simple shapes are regular expressions in the JVM. Only nested review cards need
a markup parser; it runs on Arrow batches and sees one page at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from staylens.functions.text import list_hotel_id, null_if_empty, trim_ws

# Where the saved pages keep their parts, as steps of
# (tag, attributes that must be present), outermost first.
CARD = {
    "card": [("div", {"data-test-target": "HR_CC_CARD"})],
    "title": [("div", {"class": "_a"}), ("a", {}), ("span", {}), ("span", {})],
    "name": [
        ("div", {"class": "ZRBpD P _c"}), ("div", {}), ("span", {}), ("a", {}), ("span", {}),
    ],
    "body": [
        ("div", {"class": "_c"}), ("div", {"class": "fIrGe _T bgMZj"}), ("div", {}), ("span", {}),
        ("div", {}), ("span", {}),
    ],
}
LIST_REVIEW = {
    "card": [
        (None, {"id": "reviews"}), ("section", {}), ("div", {"class": "y-css-mhg9c5"}), ("ul", {}),
        ("li", {}),
    ],
    "name": [
        ("div", {"class": "y-css-9vtc3g"}), ("div", {"class": "y-css-8x4us"}), ("div", {}),
    ],
    "body": [("div", {"class": "y-css-mhg9c5"}), ("div", {"nth": 3}), ("p", {})],
    "fallback": [("p", {})],
}
LIST_ITEM = r'(?s)<li[^>]*class="[^"]*\bstFPg\b[^"]*"[^>]*>(.*?)</li>'
LIST_LINK = r"""(?s)<a[^>]*href=["']([^"']*/Hotel_Review-[^"']*)["']"""
LIST_NAME = r"(?s)<h3[^>]*>(.*?)</h3>"
LIST_HOST = "https://www.tripadvisor.com"
PARAGRAPH = r"(?s)<p>(.*?)</p>"
TAGS = r"(?s)<[^>]*>"
STAR_LABEL = "star rating"
# A new element of the first kind closes an open one unless one of the others lies between.
CLOSED_BY_NEXT = {
    "p": {"article", "blockquote", "body", "button", "div", "li", "section", "td"},
    "li": {"ol", "ul"},
}
VOID_TAGS = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track",
    "wbr",
}


class _Node:
    __slots__ = ("tag", "attrs", "up", "nth", "children", "elements")

    def __init__(self, tag, attrs, up):
        self.tag, self.attrs, self.up = tag, attrs, up
        self.children, self.elements = [], 0
        if up is not None:
            up.elements += 1
        self.nth = up.elements if up is not None else 1

    def fits(self, tag, wanted) -> bool:
        if tag and self.tag != tag:
            return False
        for key, value in wanted.items():
            if key == "nth":
                if self.nth != value:
                    return False
            elif key == "class":
                if not set(value.split()) <= set((self.attrs.get("class") or "").split()):
                    return False
            elif self.attrs.get(key) != value:
                return False
        return True

    def walk(self) -> Iterator[_Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, _Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, _Node))

    def content(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack.extend(reversed(node.children))
        return "".join(out)


class _Tree(HTMLParser):
    """Element tree of a page; stray end tags and unclosed elements are tolerated."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSED_BY_NEXT:
            node = self.at
            while node.up is not None and node.tag not in CLOSED_BY_NEXT[tag] | {tag}:
                node = node.up
            if node.tag == tag:
                self.at = node.up
        node = _Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID_TAGS:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.up is not None and node.tag != tag:
            node = node.up
        if node.up is not None:
            self.at = node.up

    def handle_data(self, data):
        self.at.children.append(data)


def _matches(scope: _Node, steps: list) -> list[_Node]:
    """Nodes below ``scope`` whose ancestors fit the steps in order."""
    *outer, (tag, wanted) = steps
    found = []
    for node in scope.walk():
        if not node.fits(tag, wanted):
            continue
        need, up = list(outer), node.up
        while need and up is not None:
            if up.fits(*need[-1]):
                need.pop()
            up = up.up
        if not need:
            found.append(node)
    return found


def _text(scope: _Node, steps: list) -> str:
    return "".join(n.content() for n in _matches(scope, steps)).strip()


def _root(html: str) -> _Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def _per_page(pages: DataFrame, id_col: str, rows_of, schema: str) -> DataFrame:
    """Run a page parser over the pages; each task handles one Arrow batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (page_id, pos, *row)
                for page_id, html in zip(batch[id_col], batch["html"])
                for pos, row in enumerate(rows_of(html))
            ]
            names = [part.split()[0] for part in schema.split(", ")]
            yield pd.DataFrame(out, columns=names)

    return pages.select(id_col, "html").mapInPandas(run, schema)


def extract_cards(pages: DataFrame, id_col: str = "path", shape: dict = CARD) -> DataFrame:
    """Title, name and text of each review card; cards without any of them are dropped."""

    def rows_of(html: str):
        for card in _matches(_root(html), shape["card"]):
            row = tuple(_text(card, shape[part]) for part in ("title", "name", "body"))
            if any(row):
                yield row

    kind = dict(pages.dtypes)[id_col]
    schema = f"{id_col} {kind}, pos int, title string, name string, body string"
    return _per_page(pages, id_col, rows_of, schema)


def extract_list_reviews(pages: DataFrame, id_col: str = "path",
                         shape: dict = LIST_REVIEW) -> DataFrame:
    """Name, text and stars of each list item; text falls back to any paragraph."""

    def rows_of(html: str):
        for item in _matches(_root(html), shape["card"]):
            body = _text(item, shape["body"]) or _text(item, shape["fallback"])
            labels = [
                n.attrs.get("aria-label") or ""
                for n in item.walk()
                if n.tag == "div" and n.attrs.get("role") == "img"
            ]
            label = next((x for x in labels if STAR_LABEL in x), "")
            stars = re.search(r"(\d+) star", label)
            if body:
                yield _text(item, shape["name"]), body, float(stars[1]) if stars else 0.0

    kind = dict(pages.dtypes)[id_col]
    schema = f"{id_col} {kind}, pos int, name string, body string, rating double"
    return _per_page(pages, id_col, rows_of, schema)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, TAGS, "")


def extract_hotel_links(pages: DataFrame, id_col: str = "path") -> DataFrame:
    """Hotel id, name and absolute link of each complete item of a list page."""
    items = pages.select(
        id_col, F.explode(F.regexp_extract_all("html", F.lit(LIST_ITEM), F.lit(1))).alias("item")
    )
    href = null_if_empty(F.regexp_extract("item", LIST_LINK, 1))
    name = null_if_empty(trim_ws(strip_tags(F.regexp_extract("item", LIST_NAME, 1))))
    link = F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(LIST_HOST), href))
    out = items.select(
        id_col, list_hotel_id(href).alias("source_hotel_id"), name.alias("name"), link.alias("url")
    )
    return out.dropna(subset=["source_hotel_id", "name", "url"])


def extract_text(pages: DataFrame, id_col: str = "path") -> DataFrame:
    """All non-blank paragraphs of a page, one per line; pages without any are dropped."""
    texts = F.transform(
        F.regexp_extract_all("html", F.lit(PARAGRAPH), F.lit(1)), lambda p: trim_ws(strip_tags(p))
    )
    joined = F.array_join(F.filter(texts, lambda t: t != ""), "\n")
    return pages.select(id_col, joined.alias("review_text")).filter(F.col("review_text") != "")


def parse_path_a(df: DataFrame, known_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """``City,Country/<id>_<source>_<name>.html``; other paths are dropped.

    With ``known_prefixes`` an id such as ``ta_1`` keeps its prefix.
    """
    parts = F.split("path", "/")
    place = F.split(F.get(parts, F.lit(0)), ",")
    tokens = F.split(F.regexp_replace(F.get(parts, F.lit(1)), r"\.html\z", ""), "_")
    if known_prefixes:
        joined = F.concat(
            F.array(F.concat_ws("_", F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1)))),
            F.filter(tokens, lambda _, i: i > 1),
        )
        tokens = F.when(F.get(tokens, F.lit(0)).isin(*known_prefixes), joined).otherwise(tokens)
    ok = (F.size(parts) == 2) & (F.size(place) == 2) & (F.size(tokens) >= 3)
    return df.filter(F.col("path").endswith(".html")).filter(ok).select(
        "path",
        F.get(tokens, F.lit(0)).alias("hotel_id"),
        F.get(tokens, F.lit(1)).alias("source"),
        F.array_join(F.filter(tokens, lambda _, i: i > 1), " ").alias("name"),
        F.get(place, F.lit(0)).alias("city"),
        F.get(place, F.lit(1)).alias("country"),
    )


def parse_path_b(df: DataFrame, known_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """``City,Country/…/reviews-<name>-<id>.html``: the id follows the last dash.

    With ``known_prefixes`` an id that itself contains dashes is read from its
    prefix on.
    """
    parts = F.split("path", "/")
    file = F.regexp_replace(F.element_at(parts, -1), r"\.html\z", "")
    hotel_id = F.substring_index(file, "-", -1)
    if known_prefixes:
        pattern = rf"-((?:{'|'.join(known_prefixes)})_.*)\z"
        hotel_id = F.coalesce(null_if_empty(F.regexp_extract(file, pattern, 1)), hotel_id)
    ok = (
        F.col("path").contains("reviews-")
        & F.col("path").endswith(".html")
        & (F.size(parts) >= 2)
        & F.get(parts, F.lit(0)).contains(",")
        & file.contains("-")
    )
    return df.filter(ok).select("path", hotel_id.alias("hotel_id"))
