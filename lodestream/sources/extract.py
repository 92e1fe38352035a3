"""Articles of web pages: title, author, date, sections, tables and figures, disclaimer.

A page is read into a small tree inside a task, one page at a time. The text
comes from the container with the most running text (or an article within it
that holds most of that), else from structured data, else from all paragraphs,
else from an article element that has no paragraphs. Tables and figures keep
the section that they stand behind.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestream.operators.articles import partition_segments, publication_date

VOID = {"br", "img", "meta", "link", "input", "hr", "source", "col", "wbr", "area", "base", "embed", "track"}
# What a page's frame is made of, what marks an article, and what marks pictures of something else.
FRAME_TAGS = {"script", "style", "noscript", "nav", "header", "footer", "aside", "svg", "button", "iframe", "form"}
FRAME_ROLES = {"navigation", "banner", "contentinfo", "search"}
FRAME_CLASSES = ("nav", "menu", "header", "footer", "cookie", "consent", "subscribe", "breadcrumb", "newsletter", "related", "share")
BODY_CLASSES = ("article", "post", "content", "rich-text", "body-copy")
DECORATION = ("author", "byline", "bio", "profile", "headshot", "avatar", "contributor", "team", "staff", "portrait", "people", "social", "share", "related", "recommend", "promo", "advert", "newsletter", "subscribe", "cta", "footer", "sidebar", "disclaimer")
#: Characters of a paragraph, of a container's paragraphs, and of an article without paragraphs, at least.
PARAGRAPH, CONTAINER, BARE = 40, 300, 700
ROWS, COLUMNS, CELL, SPAN = 80, 14, 400, 8


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    parent: Node | None = None

    def walk(self) -> Iterator[Node]:
        """All nodes below, in the order of the page."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                if node.tag == "br":
                    out.append(" ")
                stack += reversed(node.children)
        return " ".join("".join(out).split())

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def classes(self) -> str:
        return self.attrs.get("class", "").lower()

    def drop(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]


class _Tree(HTMLParser):
    """Nodes of a page; paragraphs, items, cells and rows that are left open end where the next one begins."""

    ENDS = {"p": {"p", "h1", "h2", "h3", "h4", "ul", "ol", "table", "div", "section", "article", "figure"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
    SCOPE = {"table", "ul", "ol", "div", "section", "article", "main", "body"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("#root")

    def handle_starttag(self, tag, attrs):
        while tag in self.ENDS.get(self.now.tag, ()) or (tag in ("td", "th", "tr", "li") and self.now.tag not in self.SCOPE and any(n.tag in self.ENDS and tag in self.ENDS[n.tag] for n in self._scope())):
            self.now = self.now.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, parent=self.now)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def _scope(self) -> Iterator[Node]:
        for n in self.now.above():
            if n.tag in self.SCOPE:
                return
            yield n

    def handle_endtag(self, tag):
        if any(n.tag == tag for n in (self.now, *self.now.above())):
            while self.now.tag != tag:
                self.now = self.now.parent
            self.now = self.now.parent or self.root

    def handle_data(self, data):
        self.now.children.append(data)


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def _structured(root: Node) -> dict[str, str]:
    """The record of embedded data with the longest body that is an article or has a headline: title, body, author, date."""
    best = {"title": "", "body": "", "author": "", "date": ""}
    for script in root.find("script"):
        if "json" not in script.attrs.get("type", "").lower():
            continue
        try:
            stack = [json.loads("".join(c for c in script.children if isinstance(c, str)))]
        except ValueError:
            continue
        while stack:
            r = stack.pop()
            if isinstance(r, list):
                stack += r
            elif isinstance(r, dict):
                stack += r.values()
                said = lambda *names: next((v for n in names if (v := _said(r.get(n)))), "")  # noqa: B023, E731
                body, title = said("articleBody", "text", "body"), said("headline", "title")
                if len(body) > len(best["body"]) and (title or re.search("Article|Report|Analysis|BlogPosting", str(r.get("@type") or ""), re.I)):
                    best = {"title": title, "body": body, "author": said("author", "creator"), "date": said("datePublished", "publishedAt", "publishDate", "publicationDate")}
    return best


def _said(value: object) -> str:
    if isinstance(value, list):
        value = value[0] if value else ""
    if isinstance(value, dict):
        value = value.get("name")
    return value.strip() if isinstance(value, str) else ""


def _frame(node: Node) -> bool:
    block = node.tag in ("div", "section") and any(c in node.classes() for c in FRAME_CLASSES)
    return node.tag in FRAME_TAGS or node.attrs.get("role") in FRAME_ROLES or node.attrs.get("aria-hidden") == "true" or block


def _is_article(node: Node) -> bool:
    return node.tag in ("article", "main") or node.attrs.get("itemprop") == "articleBody"


def _running(node: Node) -> list[str]:
    """Texts of paragraphs, and of items that hold none."""
    return [n.text() for n in node.walk() if n.tag == "p" or (n.tag == "li" and not n.find("p"))]


def _weight(node: Node) -> int:
    return sum(len(t) for t in _running(node) if len(t) > PARAGRAPH)


def container(root: Node) -> Node | None:
    """The part of a page with the most running text, or the article inside it that holds 65 % of that; None under CONTAINER characters."""
    marked = [n for n in root.walk() if _is_article(n) or any(c in n.classes() for c in BODY_CLASSES)]
    best = max(marked, key=_weight, default=None)  # the first of equals
    if best is None or _weight(best) < CONTAINER:
        return None
    inner = [n for n in best.walk() if n.tag == "article" or n.attrs.get("itemprop") == "articleBody" or "article" in n.classes().split()]
    inside = max(inner, key=_weight, default=None)
    return inside if inside is not None and _weight(inside) >= 0.65 * _weight(best) else best


def data_table(table: Node) -> tuple[str | None, bool, list[list[str]]] | None:
    """(caption, whether the first row is a heading, rows) of a table that holds a grid; None for one that lays out the page.

    A merged cell is repeated. A heading is marked by ``th`` or ``thead``, or is a first row of labels without digits over
    rows with some.
    """
    rows, marked = [], bool(table.find("thead"))
    for tr in table.find("tr"):
        if next(n for n in tr.above() if n.tag == "table") is not table:
            continue
        cells: list[str] = []
        for cell in (c for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")):
            marked = marked or cell.tag == "th"
            span = cell.attrs.get("colspan", "")
            cells += [cell.text()] * (min(SPAN, int(span)) if span.isdigit() and int(span) else 1)
        if any(cells):
            rows.append(cells)
    width = max(map(len, rows), default=0)
    if len(rows) < 2 or width < 2 or sum(bool(c) for r in rows for c in r) < 3:
        return None
    rows = [r + [""] * (width - len(r)) for r in rows]
    digit = lambda r: any(re.search(r"\d", c) for c in r)
    labels = all(rows[0]) and not digit(rows[0]) and any(map(digit, rows[1:]))
    caption = next((n.text() for n in table.find("caption")), "")
    return caption[:300] or None, marked or labels, [[c[:CELL] for c in r[:COLUMNS]] for r in rows[:ROWS]]


def _picture(node: Node, url: str | None) -> str | None:
    if any(word in f"{n.classes()} {n.attrs.get('id', '').lower()} {n.attrs.get('data-testid', '').lower()}" for n in [node, *list(node.above())[:5]] for word in DECORATION):
        return None
    img = node if node.tag == "img" else next(iter(node.find("img")), None)
    if img is None:
        return None
    found = next((v for a in ("src", "data-src", "data-original", "data-lazy-src") if (v := img.attrs.get(a, "").strip())), "") or (img.attrs.get("srcset", "").split(",")[-1].split() or [""])[0]
    absolute = urljoin(url or "", found) if found else ""
    return absolute if re.match("https?:", absolute) and not re.search(r"\.svg($|\?)", absolute, re.I) else None


def extract(html: str | None, url: str | None, today: dt.date) -> dict:
    """title, author, published, sections [(heading, text)], tables and figures [(behind section, ...)], disclaimer of a page."""
    root = parse(html)
    known = _structured(root)
    meta = {n.attrs.get("property") or n.attrs.get("name") or n.attrs.get("itemprop"): n.attrs.get("content", "").strip() for n in reversed(root.find("meta"))}
    times = [n for n in root.walk() if n.tag == "time" or any(c in n.classes() for c in ("publish", "date"))]
    shown = [t for n in times if len(t := n.attrs.get("datetime") or n.text()) <= 160]
    for node in list(root.walk()):
        if _frame(node) and not any(map(_is_article, node.walk())):
            node.drop()

    h1 = next((n.text() for n in root.find("h1")), "")
    og = meta.get("og:title") or ""
    slug = bool(re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+){2,}", og, re.I))
    raw = " ".join(((og if not slug else "") or h1 or known["title"] or next((n.text() for n in root.find("title")), "")).split())
    title = raw if raw in (h1, " ".join(known["title"].split())) else re.sub(r"\s+[|–—-]\s+[^|–—-]{0,40}$", "", raw).strip()
    author = meta.get("author") or next((n.text() for n in root.walk() if n.attrs.get("rel") == "author"), "") or known["author"]
    told = [meta.get("article:published_time"), meta.get("date"), meta.get("datePublished"), known["date"], *shown]
    published = next((d for t in told if t and (d := publication_date([t], today))), None)

    sections: list[tuple[str | None, str]] = []
    tables: list[tuple] = []
    figures: list[tuple] = []
    best = container(root)
    if best is not None:
        heading: str | None = None
        lines: list[str] = []
        claimed: set[int] = set()
        seen: set[str] = set()
        behind = lambda: len(sections) if lines else max(-1, len(sections) - 1)
        for n in best.walk():
            if n.tag == "table" and (grid := data_table(n)):
                claimed.add(id(n))
                tables.append((behind(), *grid))
            if any(id(a) in claimed for a in n.above()):
                continue
            if n.tag in ("figure", "img"):
                if n.tag == "img" and any(a.tag == "figure" for a in n.above()):
                    continue
                at = _picture(n, url)
                if at and at not in seen:
                    seen.add(at)
                    figures.append((behind(), at, next((c.text() for c in n.find("figcaption")), "") or None))
            elif n.tag in ("h2", "h3", "h4") and (text := n.text()):
                if lines:
                    sections.append((heading, "\n\n".join(lines)))
                heading, lines = text[:160], []
            elif n.tag == "li" and not n.find("p") and len(text := n.text()) >= 2:
                lines.append("• " + text)
            elif n.tag == "p" and len(text := n.text()) > PARAGRAPH:
                lines.append(text)
        if lines:
            sections.append((heading, "\n\n".join(lines)))
    if not sections:
        body = "\n\n".join(p for p in (" ".join(x.split()) for x in re.split(r"\n\s*\n|\\n\s*\\n", known["body"])) if len(p) > PARAGRAPH)
        paragraphs = "\n\n".join(t for n in root.find("p") if len(t := n.text()) > PARAGRAPH + 10)
        whole = max((n.text() for n in root.walk() if _is_article(n) or n.attrs.get("role") == "main"), key=len, default="")
        sections = [(None, t) for t in (body if len(body) >= CONTAINER else "", paragraphs, whole if len(whole) >= BARE else "") if t][:1]
    kept, disclaimer = partition_segments(sections)
    clamp = lambda rows: [(min(len(kept) - 1, r[0]), *r[1:]) for r in rows] if kept else []
    published = published or publication_date([title, "\n\n".join(t for _, t in kept)[:1200]], today)
    return {"title": title, "author": author[:120] or None, "published": published, "sections": kept, "tables": clamp(tables), "figures": clamp(figures), "disclaimer": disclaimer}


KIND = pa.schema([
    ("title", pa.string()), ("author", pa.string()), ("published", pa.date32()), ("sections", pa.list_(pa.struct([("heading", pa.string()), ("text", pa.string())]))),
    ("tables", pa.list_(pa.struct([("behind", pa.int32()), ("caption", pa.string()), ("header", pa.bool_()), ("cells", pa.list_(pa.list_(pa.string())))]))),
    ("figures", pa.list_(pa.struct([("behind", pa.int32()), ("url", pa.string()), ("caption", pa.string())]))), ("disclaimer", pa.string()),
])
DDL = "title string, author string, published date, sections array<struct<heading:string,text:string>>, tables array<struct<behind:int,caption:string,header:boolean,cells:array<array<string>>>>, figures array<struct<behind:int,url:string,caption:string>>, disclaimer string"


def articles(pages: DataFrame, key: str, html: str, url: str, today: dt.date) -> DataFrame:
    """One row a page with the columns of DDL; pages without text have no sections."""
    names = {f.name: [x.name for x in f.type.value_type] for f in KIND if pa.types.is_list(f.type)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # a page at a time
                found = extract(batch.column(html)[at].as_py(), batch.column(url)[at].as_py(), today)
                row = {k: [dict(zip(names[k], x, strict=True)) for x in v] if k in names else v for k, v in found.items()}
                out = pa.RecordBatch.from_pylist([row], KIND)
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(at, 1), *out.columns], [key, *KIND.names])

    return pages.select(key, html, url).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, {DDL}")
