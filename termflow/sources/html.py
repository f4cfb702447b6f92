"""HTML pages as blocks. The tag tree needs a parser, so pages pass through one small function
per batch; everything after it is columns."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIP, HEAD, BLOCK = set(K.HTML_SKIP_TAGS), set(K.HTML_HEADING_TAGS), set(K.HTML_BLOCK_TAGS)
#: Pages whose blocks leave a task together, and characters of pages from which they do before.
PAGES, PAGE_CHARS = 200, 1 << 20
CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
ENDS_P = {"p", "div", "ul", "ol", "table", "article", "section", "nav", "header", "footer", "dl", "form", "pre"} | HEAD


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = {"tag": "", "attrs": {}, "kids": []}
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        top = self.stack[-1]["tag"]
        if top in CLOSES.get(tag, ()) or (top == "p" and tag in ENDS_P):
            self.stack.pop()
        node = {"tag": tag, "attrs": dict(attrs), "kids": []}
        self.stack[-1]["kids"].append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i]["tag"] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1]["kids"].append(data)


def _words(node) -> list[str]:
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            if n.strip():
                out.append(n.strip())
        elif n["tag"] not in SKIP:
            stack += reversed(n["kids"])
    return out


def _in_order(root) -> list[dict]:
    """All elements outside skipped ones, parents first."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [k for k in reversed(n["kids"]) if not isinstance(k, str) and k["tag"] not in SKIP]
    return out


def _mark_blocks(root) -> None:
    """Note on every element whether a heading or block element stands below it."""
    for n in reversed(_in_order(root)):
        n["has_block"] = any(not isinstance(k, str) and k["tag"] not in SKIP and (
            k["tag"] in BLOCK or k["tag"] in HEAD or k["has_block"]) for k in n["kids"])


def _body(root):
    stack = [root]
    while stack:
        n = stack.pop()
        if n["tag"] == "body":
            return n
        stack += [k for k in reversed(n["kids"]) if not isinstance(k, str)]
    return None


def _visit(top, out) -> None:
    stack = [top]
    while stack:
        node = stack.pop()
        if isinstance(node, str) or node["tag"] in SKIP or node["attrs"].get("translate") == "no":
            continue
        tag = node["tag"]
        if tag in HEAD:
            out.append(("heading", tag, "", " ".join(_words(node))))
            continue
        leaf = tag in BLOCK and not node["has_block"]
        if leaf:
            out.append(("paragraph", tag, "", " ".join(_words(node))))
        for a in K.HTML_TEXT_ATTRS:
            out.append(("paragraph", tag, a, (node["attrs"].get(a) or "").strip()))
        if not leaf:
            stack += reversed(node["kids"])


def _blocks(html: str):
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    _mark_blocks(tree.root)
    out: list[tuple] = []
    for k in (_body(tree.root) or tree.root)["kids"]:
        _visit(k, out)
    return [(i, *b) for i, b in enumerate(b for b in out if b[3])]


def _arrow_blocks(batches, key: str):
    """Blocks of Arrow batches (key, html), a few pages at a time: a batch is never held as Python objects."""
    names, kinds = [key, "seq", "type", "tag", "attr", "source_text"], [pa.int32(), *[pa.string()] * 4]
    for b in batches:
        rows, at, chars = [], [], 0
        for i in range(b.num_rows):
            page = b.column(1)[i].as_py()
            found = _blocks(page)
            rows += found
            at += [i] * len(found)
            chars += len(page or "")
            if rows and (i + 1 == b.num_rows or (i + 1) % PAGES == 0 or chars >= PAGE_CHARS):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *[
                    pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names)
                rows, at, chars = [], [], 0


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, seq, type, tag, attr, source_text) in page order."""
    schema = f"{key} {dict(pages.dtypes)[key]}, seq int, type string, tag string, attr string, source_text string"
    return pages.select(key, html).mapInArrow(lambda batches: _arrow_blocks(batches, key), schema).where(
        T.is_translatable(F.col("source_text")))


def tag_histogram(pages: DataFrame, html: str = "html") -> DataFrame:
    tags = F.regexp_extract_all(F.lower(html), F.lit(r"<([a-z][a-z0-9]*)"), F.lit(1))
    return pages.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
