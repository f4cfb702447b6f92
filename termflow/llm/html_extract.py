"""Main text of pages by wrapper induction.

The pages of a host are made by one template. Their element trees are aligned with a reference page of
the host by simple tree matching; aligned nodes whose text stays the same are template, those whose text
varies are slots, and the slots that hold running text are content.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .url_filter import host_of

#: Elements without an end tag.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
#: Elements that never hold main text.
ASIDE = set("head script style title nav header footer aside form button select option textarea noscript iframe template "
            "svg canvas object embed audio video dialog menu label input".split())
#: Elements that start a new block of text.
BLOCK = set("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure "
            "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td "
            "tfoot th thead tr ul".split())
#: What an open element is closed by, where its end tag may be left out.
ENDS_P = BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
            "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
          "option": {"select"}}
#: Words in class, id and role that name what stands around an article.
AROUND = set("ad ads adsbygoogle adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments "
             "commentlist cookie cookies consent disclaimer discussion disqus feedback footer gdpr header login masthead menu modal "
             "nav navbar navigation newsletter notice notices notification pager pagination popup promo related "
             "recommended replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe survey "
             "toolbar topbar widget contentinfo complementary".split())
#: Words that say nothing beside one of those.
PLAIN = set("a an and area bar block bottom box btn button buttons by center col column container content copy fixed form global group "
            "holder icon icons inner item items js left link links list local main module my of page panel post posts primary right row "
            "secondary section sec site slot sticky sub text the top ui unit upper view widgets wp wrap wrapper x".split())
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>")
WINDOW = 2048
_SPECIAL = re.compile(r"[>\"']")
_NAME_END = re.compile(r"[\s/>]")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
#: Share of aligned pages on which the text of a template node stays the same.
CONSTANT = 0.5
#: Different pages of a host that must have a text in one place before it can be template.
PAGES = 3


@dataclass
class Node:
    tag: str
    label: str
    aside: bool  # an element that never holds main text, or hidden
    named: bool  # its names say that it stands around an article
    holds: bool = False  # an article or a main heading stands below
    children: list = field(default_factory=list)  # nodes and texts in order

    @property
    def around(self) -> bool:
        """What holds the article is not around it, whatever its names; so a form over a whole page."""
        return self.aside and not (self.holds and self.tag == "form") or self.named and not self.holds


class _Tags:
    """Finds ends of tags in one pass over a page: whatever is asked, no character is looked at more than a few times."""

    def __init__(self, page: str):
        self.page, self.known = page, {}
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.special, self.name = (-1, -1), (-1, -1)  # asked from, found at

    def _next(self, pattern: re.Pattern, held: tuple[int, int], at: int) -> tuple[int, int]:
        if held[0] <= at <= held[1]:
            return held
        m = pattern.search(self.page, at)
        return at, m.start() if m else len(self.page)

    def end(self, at: int) -> int:
        """Place of the `>` that ends a tag whose attributes begin at `at`, outside of quotes; -1 if none does."""
        self.special = self._next(_SPECIAL, self.special, at)
        i, seen = self.special[1], []
        while True:
            if i in self.known:
                found = self.known[i]
                break
            if i >= len(self.page):
                found = -1
                break
            seen.append(i)
            c = self.page[i]
            if c == ">":
                found = i
                break
            if self.last[c] <= i:
                found = -1
                break
            close = self.page.index(c, i + 1)
            m = _SPECIAL.search(self.page, close + 1)
            i = m.start() if m else len(self.page)
        for k in seen:
            self.known[k] = found
        return found

    def name_end(self, at: int) -> int:
        self.name = self._next(_NAME_END, self.name, at)
        return self.name[1]


def parse(page: str) -> Node:
    """A forgiving tree of a page: elements left open are closed by what follows or at the end; what cannot be a
    tag is text. Its time grows with the page alone, however malformed that is: common tags are matched
    within WINDOW characters, others are found by _Tags."""
    root = Node("#page", "#page", False, False)
    stack, open_ = [root], Counter()
    tags, at, n = _Tags(page), 0, len(page)
    last_end, last_cdata = tags.last[">"], page.rfind("]]>")

    def cut(i: int) -> None:
        for x in stack[i:]:
            open_[x.tag] -= 1
        del stack[i:]

    while at < n:
        if page[at] != "<":
            stop = page.find("<", at)
            stop = n if stop < 0 else stop
            stack[-1].children.append(page[at:stop])
            at = stop
            continue
        m = _TAG.match(page, at, at + WINDOW)
        if m:
            closing, tag, attributes = m[1], m[2].lower(), m[3]
            at = m.end()
        else:
            if page.startswith("<!--", at):
                stop = page.find("-->", at + 4)
                at = n if stop < 0 else stop + 3
                continue
            if page.startswith("<![CDATA[", at) and last_cdata >= at + 9:
                stop = page.find("]]>", at + 9)
                stack[-1].children.append(page[at + 9:stop].replace("&", "&amp;"))
                at = stop + 3
                continue
            if page[at + 1:at + 2] in ("!", "?") and last_end > at:
                at = page.find(">", at) + 1
                continue
            closing = page.startswith("</", at)
            begin = at + 1 + closing
            first, stop = page[begin:begin + 1], -1
            if first.isascii() and first.isalpha() and last_end > at:
                name = tags.name_end(begin)
                stop = tags.end(name)
            if stop < 0:
                stack[-1].children.append("<")
                at += 1
                continue
            tag, attributes, at = page[begin:name].lower(), page[name:stop], stop + 1
        if closing:
            if open_[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                cut(i)
            continue
        if tag in ENDS_P and open_["p"]:
            cut(_closed(stack, {"p"}, {"article", "section", "div", "td", "th", "li", "body", "table", "button"}))
        if tag in SIBLINGS and any(open_[t] for t in SIBLINGS[tag]):
            cut(_closed(stack, SIBLINGS[tag], SCOPES[tag]))
        node = Node(tag, *(_label(tag, attributes) if attributes else (tag, tag in ASIDE, False)))
        stack[-1].children.append(node)
        if tag in ("article", "main", "h1"):
            for x in reversed(stack):
                if x.holds:
                    break
                x.holds = True
        if tag in RAW:  # go on after its end tag
            m = re.compile(rf"</{re.escape(tag)}\s*", re.I).search(page, at) if last_end > at else None
            at = page.find(">", m.end()) + 1 if m and last_end >= m.end() else n
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(node)
            open_[tag] += 1
    return root


def _closed(stack: list[Node], tags: set[str], scope: set[str]) -> int:
    """Where the stack is cut by a tag that closes one of `tags` within `scope`."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            return i
        if stack[i].tag in scope:
            break
    return len(stack)


def _label(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Tag with its class and id, whether it is never main text, and whether it names something around."""
    names, hidden, named = [], False, False
    if attributes:
        for name, value in _NAMES.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value == "true" or (
                    name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                hidden = True
            elif name in ("class", "id", "role"):
                for one in value.split():
                    parts = _WORDS.findall(_CAMEL.sub(" ", one).lower())
                    names += parts
                    # All of a name says what stands there: `site-header` is one, `share-price` is not.
                    named |= bool(AROUND & set(parts)) and set(parts) <= AROUND | PLAIN
    named &= tag not in ("html", "body", "article", "main")
    return " ".join([tag, *sorted(set(names))]), tag in ASIDE or hidden, named


def text_of(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        else:
            stack += reversed(n.children)
    return _SPACE.sub(" ", entities.unescape("".join(out))).strip()


#: Levels of the folded tree.
FOLDED = 24


@dataclass
class Slot:
    """A node of the folded tree: siblings with one label stand in one slot."""

    label: str
    nodes: list
    children: list
    digest: int = 0


def fold(nodes: list[Node], label: str = "#page", depth: int = 0) -> Slot:
    """The tree with repeated siblings folded together, as rows of a list are. Inline elements and
    what stands below FOLDED levels belong to the text of their parent, so a text is in a digest at any depth."""
    groups: dict[str, list[Node]] = {}
    if depth < FOLDED:
        for n in nodes:
            for c in n.children:
                if not isinstance(c, str) and c.tag in _STRUCTURE:
                    groups.setdefault(c.label, []).append(c)
    slot = Slot(label, nodes, [fold(v, k, depth + 1) for k, v in groups.items()])
    digest = 0
    for n in nodes:
        for c in n.children:
            if isinstance(c, str):
                digest = zlib.crc32(c.strip().encode("utf-8", "replace"), digest)
            elif (c.tag not in _STRUCTURE or depth >= FOLDED) and c.tag not in ASIDE:
                digest = zlib.crc32(text_of(c).encode("utf-8", "replace"), digest)
    for c in slot.children:
        digest = zlib.crc32(c.digest.to_bytes(4, "little"), digest)
    slot.digest = digest
    return slot


_STRUCTURE = (BLOCK | ASIDE) - {"br", "hr", "label", "input", "button", "option", "script", "style", "title", "head"}


def skeleton(slot: Slot) -> list:
    return [slot.label, slot.digest, [skeleton(c) for c in slot.children]]


def align(a: list, b: list) -> list[tuple[list, list]]:
    """Simple tree matching of two skeletons: the largest set of matched nodes that keeps order and
    parents; both lists of pairs hold the skeleton nodes themselves."""
    pairs: list[tuple[list, list]] = []
    _match(a, b, {}, pairs)
    return pairs


def _match(a: list, b: list, memo: dict, pairs: list | None) -> int:
    """Size of the best matching of two trees with equal roots; with `pairs`, also what it matches."""
    if a[0] != b[0]:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        left, right = a[2], b[2]
        table = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, x in enumerate(left, 1):
            for j, y in enumerate(right, 1):
                table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + _match(x, y, memo, None))
        memo[key] = (table[-1][-1] + 1, table)
    size, table = memo[key]
    if pairs is not None:
        pairs.append((a, b))
        i, j = len(a[2]), len(b[2])
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                _match(a[2][i - 1], b[2][j - 1], memo, pairs)
                i, j = i - 1, j - 1
    return size


def _numbered(tree: list) -> dict[int, int]:
    out, stack = {}, [tree]
    while stack:
        n = stack.pop()
        out[id(n)] = len(out)
        stack += reversed(n[2])
    return out


def votes(page: list, reference: list) -> list[tuple[int, int]]:
    """(number of the reference node, digest of the text that the page has there)."""
    number = _numbered(reference)
    return [(number[id(r)], p[1]) for p, r in align(page, reference)]


def article_digest(page: Node, tree: str) -> int:
    """What tells articles from copies in other surroundings: the text of article or main, or else all but
    what stands around; the tree where that is empty."""
    text = content(page, None, {})
    digest = xxhash.xxh64_intdigest((text or tree).encode("utf-8", "replace"), 0 if text else 1)
    return digest - (1 << 64) if digest >> 63 else digest


def content(page: Node, reference: list | None, constant: dict[int, int]) -> str:
    """Blocks of main text of a page, given the reference of its host and the text digests of its template
    nodes. Only a node that has the text of the template is dropped."""
    slots = fold([page])
    tree = skeleton(slots)
    template: set[int] = set()
    if reference is not None:
        number = _numbered(reference)
        fixed = {id(p) for p, r in align(tree, reference) if constant.get(number[id(r)]) == p[1]}
        stack = [(slots, tree)]
        while stack:
            slot, node = stack.pop()
            if id(node) in fixed and not (slot.label.split()[0] in ("#page", "html", "body", "article", "main")):
                template |= {id(n) for n in slot.nodes}
            stack += zip(slot.children, node[2], strict=True)
    roots = _roots(page)
    blocks: list[str] = []
    for r in roots:
        _blocks(r, template, blocks)
    return "\n".join(blocks)


#: An article that holds less than this share of a page's text is a teaser, and the page is its own article.
TEASER = 0.2


def _roots(page: Node) -> list[Node]:
    """Where the article stands: in article or main elements, if they hold a fair share of the text."""
    found = _articles(page)
    if not found:
        return [page]
    return found if sum(map(_letters, found)) >= TEASER * _letters(page) else [page]


def _letters(root: Node) -> int:
    """Characters of text that does not stand around an article."""
    n, stack = 0, [root]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, str):
                n += len(c)
            elif not c.around:
                stack.append(c)
    return n


def _articles(page: Node) -> list[Node]:
    """The outermost article elements, else main, outside of what stands around an article."""
    for tag in ("article", "main"):
        found, stack = [], [page]
        while stack:
            n = stack.pop()
            if n.tag == tag:
                found.append(n)
            elif not n.around:
                stack += [c for c in reversed(n.children) if not isinstance(c, str)]
        if found:
            return found
    return []


def _blocks(root: Node, template: set[int], out: list[str]) -> None:
    held: list[str] = []
    inside = root.tag in ("article", "main")  # a header with the heading of the article belongs to it

    def end() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append(text)

    stack: list = [root]
    while stack:
        n = stack.pop()
        if n is None:
            end()
        elif isinstance(n, str):
            held.append(n)
        elif (n.around and not (n.tag == "header" and n.holds and inside)) or id(n) in template:
            if n.tag in BLOCK:
                end()
        elif n.tag == "br":
            held.append(" ")
        elif n.tag in BLOCK:
            end()
            stack.append(None)
            stack += reversed(n.children)
        else:
            stack += reversed(n.children)
    end()


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
            constant: float = CONSTANT) -> DataFrame:
    """(page_id, url, text) of every row of `pages`.

    1. Every page is parsed and folded to a skeleton of labels and text digests, which is stored.
    2. The reference of a host is a page of its most frequent shape. Different pages are aligned with it;
       a node that has one text on more than `constant` of the aligned pages, and on PAGES at
       least, is template. Copies of an article count once, whatever surrounds them, so what is copied does
       not become template.
    3. Pages are aligned again, what has the text of the template and what stands around the article are dropped, and the rest
       is cut into blocks.
    Votes of a hot host are summed before they are moved. A null or empty html gives an empty text, a
    null url the host "", a host with one page no template. Repeated rows stay; other columns are not
    read; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    narrow = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"),
                          host_of(F.col(url)).alias("host"))

    def skeletons(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parsed = [parse(h or "") for h in frame["html"]]
            trees = [json.dumps(skeleton(fold([p]))) for p in parsed]
            yield pd.DataFrame({"host": frame["host"], "tree": trees,
                                "article": [article_digest(p, t) for p, t in zip(parsed, trees, strict=True)]})

    id_type = narrow.schema["page_id"].dataType.simpleString()
    trees = written(narrow.select("host", "html").mapInPandas(skeletons, "host string, tree string, article long"), "page-trees")
    trees = written(trees.groupBy("host", "article").agg(F.min_by("tree", F.struct(F.xxhash64("tree"), "tree")).alias("tree")),
                    "different-trees")
    shape = F.regexp_replace("tree", ", [0-9]+, ", ",")
    shapes = trees.groupBy("host", F.xxhash64(shape).alias("shape")).agg(
        F.count("*").alias("n"), F.min_by("tree", F.struct(F.xxhash64("tree"), "tree")).alias("tree"))
    references = written(shapes.groupBy("host").agg(
        F.max_by("tree", F.struct("n", "shape")).alias("reference"), F.sum("n").alias("pages")), "page-references")

    def vote(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(h, n, d) for h, t, r in zip(frame["host"], frame["tree"], frame["reference"], strict=True)
                    for n, d in votes(json.loads(t), json.loads(r))]
            yield pd.DataFrame(rows, columns=["host", "node", "digest"])

    counted = (trees.select("host", "tree").join(references.where("pages > 1").select("host", "reference"), "host")
               .mapInPandas(vote, "host string, node int, digest long")
               .groupBy("host", "node", "digest").agg(F.count("*").alias("same"))
               .groupBy("host", "node").agg(F.max(F.struct("same", "digest")).alias("top"), F.sum("same").alias("n"))
               .select("host", "node", "top.same", "top.digest", "n"))
    fixed = (counted.where((F.col("same") >= PAGES) & (F.col("same") > F.col("n") * constant))
             .groupBy("host").agg(F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("fixed")))
    wrappers = written(references.where("pages > 1").join(fixed, "host", "left").select("host", "reference", "fixed"),
                       "page-wrappers")

    def texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [content(parse(h or ""), json.loads(r) if r else None, {x["node"]: x["digest"] for x in f} if f is not None else {})
                   for h, r, f in zip(frame["html"], frame["reference"], frame["fixed"], strict=True)]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": out})

    return (narrow.join(wrappers, "host", "left").select("page_id", "url", "html", "reference", "fixed")
            .mapInPandas(texts, f"page_id {id_type}, url string, text string"))
