"""Main text of web pages by tree scoring.

A page is read into a tree of its block elements.  Each paragraph gives points for its
length and its commas to the element round it, fewer to the ancestors further up; an
element's points are discounted by its link density.  The best container and those
of its siblings that look like its continuation are kept, without the menus, adverts,
forms, comments and the like inside them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

# HTML element names by what they mean here.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "textarea", "select", "title", "head", "canvas", "audio", "video"}
DROPPED = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "input", "label", "fieldset", "datalist", "embed", "applet", "map"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
PARAGRAPHS = {"p", "pre", "blockquote", "li", "dd", "dt", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "summary", "caption", "address"}
BLOCKS = PARAGRAPHS | {"html", "body", "div", "article", "section", "main", "header", "hgroup", "ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "figure", "details", "center", "hr", "search"} | DROPPED
BREAKS = {"br", "hr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A start tag of the key ends an open element of the set, up to the nearest boundary.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
BOUNDARY = {"ul", "ol", "dl", "table", "body", "html", "article", "section", "main", "div"}
# Words of a class or id, by what they mark that is not the article.
MARKS = """
menu menus nav navbar navigation breadcrumb breadcrumbs pager pagination toolbar topbar tool tools tags search
header masthead banner
footer foot meta legal
sidebar widget related recommended
notice notices notification cookie cookies consent gdpr modal popup overlay paywall
ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion
form login signup newsletter subscribe subscription share sharing social feedback
comment comments commentlist discussion reply replies responses
"""
NEGATIVE = re.compile(rf"(?:^|[\s_-])(?:{'|'.join(MARKS.split())})(?:$|[\s_-]|\d)", re.I)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text)(?:$|[\s_-])", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "points", "size", "linked", "prior", "links")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, prior: float = 1.0):
        self.tag, self.parent, self.drop, self.prior = tag, parent, drop, prior
        self.children: list[Node | str] = []  # elements, and the texts of blocks
        self.points, self.size, self.linked, self.links = 0.0, 0, 0, 0


def _traits(tag: str, attributes: str, inside_article: bool) -> tuple[bool, float]:
    """Whether an element is dropped, and what its points are multiplied by."""
    drop, prior = tag in DROPPED or (tag == "header" and not inside_article), 1.0
    if tag in ("article", "main"):
        prior = 1.5
    if attributes and not attributes.isspace():
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                if NEGATIVE.search(value) and tag not in ("html", "body", "article", "main"):
                    drop = True
                elif CONTENT.search(value):
                    prior = max(prior, 1.25)
            elif name == "role":
                drop |= value.lower() in ROLES
                prior = max(prior, 1.5) if value.lower() == "main" else prior
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value)):
                drop |= tag not in ("html", "body")
    return drop, prior


def parse(page: str) -> Node:
    """The tree of block elements; inline markup is gone, and its text is part of the block."""
    root = Node("#root", None)
    at, node, run, pos, end = [root], root, [], 0, len(page)
    opened: Counter[str] = Counter()  # how many elements of each tag are open: no search for one that isn't there
    links, linked, linked_run, link_count = 0, 0, 0, 0
    raw = ""

    def flush() -> None:
        nonlocal run, linked_run, link_count
        if run:
            text = "".join(run)
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                node.children.append(text)
                node.size += len(text)
                node.linked += min(linked_run, len(text))
                node.links += link_count
            run, linked_run, link_count = [], 0, 0

    def close(i: int) -> None:
        opened.subtract(x.tag for x in at[i:])
        del at[i:]

    while pos < end:
        m = TOKEN.search(page, pos)
        if not raw:
            text = page[pos : m.start() if m else end]
            if text:
                run.append(text)
                if links:
                    linked_run += len(text.strip())
        if not m:
            break
        pos = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA[") and not raw:
                run.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, closing = name.lower(), bool(m[1] or m[4])
        if tag in RAW and not closing and tag != "head":
            if not (m[3] or m[6] or "").endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, pos)
                if stop:
                    pos = stop.end()
                elif tag in ("script", "style", "textarea", "title"):
                    pos = end
            continue
        if tag == "a":
            if closing:
                links = max(0, links - 1)
            else:
                links, link_count = 1, link_count + 1
            continue
        if tag not in BLOCKS:
            if tag in BREAKS:
                flush()
            continue
        flush()
        links = 0
        if closing:
            for i in range(len(at) - 1, 0, -1) if opened[tag] > 0 else ():
                if at[i].tag == tag:
                    close(i)
                    break
                if tag in PARAGRAPHS and at[i].tag in BOUNDARY:
                    break
        elif tag in BREAKS or tag in VOID:
            continue
        else:
            if at[-1].tag in ("p", *HEADINGS) and (tag in BLOCKS):
                close(len(at) - 1)
            ends = CLOSES.get(tag, ())
            for i in range(len(at) - 1, 0, -1) if any(opened[x] > 0 for x in ends) else ():
                if at[i].tag in ends:
                    close(i)
                elif at[i].tag in BOUNDARY:
                    break
            if tag == "body" and opened["body"] > 0 or tag == "html" and len(at) > 1:
                continue
            drop, prior = _traits(tag, m[3] or m[6] or "", opened["article"] + opened["main"] > 0)
            new = Node(tag, at[-1], drop, prior)
            at[-1].children.append(new)
            at.append(new)
            opened[tag] += 1
        node = at[-1]
    flush()
    # sizes go up once, from the last element to the first: a child comes after its parent
    every, todo = [], [root]
    while todo:
        x = todo.pop()
        every.append(x)
        todo.extend(c for c in x.children if isinstance(c, Node))
    for x in reversed(every[1:]):
        up = x.parent
        up.size, up.linked, up.links = up.size + x.size, up.linked + x.linked, up.links + x.links
    return root


def _elements(node: Node) -> Iterator[Node]:
    """Elements that are not dropped, parents first, in page order; no recursion, as pages may be deep."""
    todo = [node]
    while todo:
        x = todo.pop()
        if not x.drop:
            yield x
            todo.extend(c for c in reversed(x.children) if isinstance(c, Node))


def link_density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def score(root: Node) -> None:
    """Points of paragraphs, passed up; then the discounts."""
    found = list(_elements(root))
    for x in found:
        texts = [c for c in x.children if isinstance(c, str)]
        if not texts:
            continue
        points = sum(0.2 + len(t) / 100 + t.count(",") / 2 + (len(t) >= 25) for t in texts)
        if x.tag in PARAGRAPHS:
            points *= 1 - link_density(x)
        if x.tag in HEADINGS:
            points *= 0.25
        up, share = (x.parent if x.tag in PARAGRAPHS else x), 1.0
        for _ in range(5):
            if up is None or up.tag == "#root":
                break
            up.points += points * share
            up, share = up.parent, share * 0.5
    for x in found:
        x.points *= (1 - link_density(x)) * x.prior


def container(root: Node) -> list[Node]:
    """The best container and the siblings that continue it."""
    best = None
    for x in _elements(root):
        if x.tag not in PARAGRAPHS and x.points > (best.points if best else 0):
            best = x
    if best is None:
        return []
    up: Node | None = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None:  # the whole of an article that is marked as such
        best = up
    if best.parent is None:
        return [best]
    out = []
    for x in best.parent.children:
        if x is best:
            out.append(x)
        elif isinstance(x, Node) and not x.drop and best.tag != "main":
            like = x.tag == best.tag and x.points >= max(2.0, 0.2 * best.points)
            text = x.tag in PARAGRAPHS and x.size > 80 and link_density(x) < 0.25
            if like or (text and best.tag != "article"):
                out.append(x)
    return out


def blocks(node: Node) -> Iterator[str]:
    """Texts of the blocks of an element in page order, without dropped elements and lists of links."""
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        elif not x.drop and not (x.tag in ("ul", "ol", "table", "div", "section") and x is not node and x.links >= 2 and link_density(x) > 0.6):
            todo.extend(reversed(x.children))


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by one space; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    score(root)
    return " ".join(t for x in container(root) for t in blocks(x))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    for batch in batches:
        ids, urls = (batch.column(c).to_pylist() for c in ("_id", "url"))
        for a in range(0, len(ids), 256):
            texts = [main_text(x) for x in batch.column("_t").slice(a, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids[a : a + 256], urls[a : a + 256], texts, list(map(len, texts))), schema, strict=True)], schema=schema)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page.

    A null or empty page, and one without an article, has an empty text; repeated rows each give a row; an empty table gives
    an empty result; other columns are ignored.  No shuffle.
    """
    C.prepare(pages.sparkSession)
    rows = pages.select(pages[id_col].cast("long").alias("_id"), pages[url_col].alias("url"), F.coalesce(pages[html_col], F.lit("")).alias("_t"))
    return rows.mapInArrow(_extract, "_id long, url string, text string, n_chars long").withColumnsRenamed({"_id": id_col, "url": url_col})
