"""Stored web pages -> articles (S5) with per-row fault isolation.

The HTML walk needs real nesting, so it runs in an Arrow UDF with the
standard library's ``html.parser``: only the ``html`` column crosses to
Python, in Arrow batches that are parsed slab by slab; domain and white-space
rules stay native.

Extraction rules: drop ``script style nav header footer iframe`` everywhere;
then the first hit, in this priority, of the element ``article``; the
classes ``article-body``, ``article-content``, ``story-body``,
``story-content``, ``post-content``, ``entry-content``; the id
``content-body``; the attribute ``itemprop="articleBody"``; else ``main``;
else ``body``; else ''. Text pieces are joined without separator, then white
space is collapsed. The title is the first ``<title>``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polarity.functions.text import collapse_whitespace, url_domain
from polarity.functions.word_runs import slabs
from polarity.schemas import require_columns

# Elements removed before extraction, and the selector priority.
DROPPED = ("script", "style", "nav", "header", "footer", "iframe")
SELECTORS = (
    ("tag", "article"),
    ("class", "article-body"), ("class", "article-content"), ("class", "story-body"),
    ("class", "story-content"), ("class", "post-content"), ("class", "entry-content"),
    ("id", "content-body"),
    ("attr", ("itemprop", "articleBody")),
)
SLAB_BYTES = 1 << 18  # html that is parsed at once
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag = tag
        self.attrs = attrs
        self.children = []
        self.parent = parent


class _TreeBuilder(HTMLParser):
    """Builds a light element tree; an end tag closes the nearest open
    element of that name, unknown end tags are ignored, comments dropped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#document", {}, None)
        self.cur = self.root

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: (v or "") for k, v in attrs}, self.cur)
        self.cur.children.append(node)
        if tag not in VOID:
            self.cur = node

    def handle_startendtag(self, tag, attrs):
        self.cur.children.append(_Node(tag, {k: (v or "") for k, v in attrs}, self.cur))

    def handle_endtag(self, tag):
        n = self.cur
        while n is not None and n is not self.root and n.tag != tag:
            n = n.parent
        if n is not None and n is not self.root:
            self.cur = n.parent

    def handle_data(self, data):
        self.cur.children.append(data)


def _walk(node):
    """Elements in document order."""
    stack = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, _Node):
            yield n
            stack.extend(reversed([c for c in n.children if isinstance(c, _Node)]))


def _text(node) -> str:
    out = []
    stack = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        else:
            stack.extend(reversed(n.children))
    return "".join(out)


def _matches(node: _Node, kind: str, value) -> bool:
    if kind == "tag":
        return node.tag == value
    if kind == "class":
        return value in node.attrs.get("class", "").split()
    if kind == "id":
        return node.attrs.get("id") == value
    name, want = value
    return node.attrs.get(name) == want


def extract(html: str | None) -> tuple[str, str]:
    """(title, article text) of one page, both before white-space collapse."""
    if not html:
        return "", ""
    p = _TreeBuilder()
    p.feed(html)
    p.close()
    root = p.root
    title = next((n for n in _walk(root) if n.tag == "title"), None)
    title_text = _text(title) if title is not None else ""
    for n in list(_walk(root)):
        if n.tag in DROPPED and n.parent is not None:
            n.parent.children = [c for c in n.parent.children if c is not n]
            n.parent = None
    for kind, value in SELECTORS:
        hit = next((n for n in _walk(root) if _matches(n, kind, value)), None)
        if hit is not None:
            return title_text, _text(hit)
    for tag in ("main", "body"):
        hit = next((n for n in _walk(root) if n.tag == tag), None)
        if hit is not None:
            return title_text, _text(hit)
    return title_text, ""


_PARSED = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("error", T.StringType()),
])


def _parsed(pages: pa.Array) -> pa.Array:
    titles, texts, errors = [], [], []
    for h in pages.to_pylist():
        if h is None or (isinstance(h, float) and math.isnan(h)):
            titles.append(None), texts.append(None), errors.append("missing html")
            continue
        try:
            t, x = extract(h)
            titles.append(t), texts.append(x), errors.append(None)
        except Exception as e:  # one bad page must not stop the others (S6)
            titles.append(None), texts.append(None), errors.append(f"{type(e).__name__}: {e}")
    return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in (titles, texts, errors)], names=_PARSED.names)


def _slabs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Pages in slabs of about ``SLAB_BYTES``, so that few are Python strings at a time."""
    for pages in batches:
        if pa.types.is_string(pages.type) or pa.types.is_large_string(pages.type):
            for rows in slabs([pa.RecordBatch.from_arrays([pages], names=["html"])], "html", SLAB_BYTES):
                yield rows.column("html")
        else:
            yield pages


@F.arrow_udf(_PARSED)
def _parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in _slabs(batches):
        yield _parsed(pages)


def parse_pages(df: DataFrame, url_col: str = "url", html_col: str = "html",
                keep_html: bool = False) -> DataFrame:
    """Every input row with ``domain, title, text, error`` added.
    Rows in = rows out; ``error`` is set where a page could not be parsed."""
    require_columns(df, [url_col, html_col])
    parsed = df.withColumn("_p", _parse(F.col(html_col)))
    out = parsed.withColumns({
        "domain": url_domain(url_col),
        "title": F.when(F.col("_p.error").isNull(), collapse_whitespace("_p.title")),
        "text": F.when(F.col("_p.error").isNull(), collapse_whitespace("_p.text")),
        "error": F.col("_p.error"),
    }).drop("_p")
    return out if keep_html else out.drop(html_col)


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, rejects); together they hold every input row."""
    return parsed.filter(F.col("error").isNull()).drop("error"), parsed.filter(F.col("error").isNotNull())
