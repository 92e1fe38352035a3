"""HTML pages to article text, segments and table grids, with the standard library's parser inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SKIP = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript"}
_VOID = {"br", "img", "meta", "link", "input", "hr"}
#: Limits of a grid and of a cell's text; a grid needs two rows, two columns and three cells.
ROWS, COLUMNS, CELL, SPAN = 80, 14, 400, 8


class _Reader(HTMLParser):
    """Blocks of running text with the heading they stand under, and table rows; skipped elements leave nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.tag, self.buffer, self.heading, self.title = 0, "", [], "", ""
        self.blocks: list[tuple[str, str, str]] = []
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None
        self.span = 1

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        elif tag in ("p", "li", "h1", "h2", "h3", "h4", "title"):
            self._close()
            self.tag = tag
        elif tag == "table":
            self.open.append([])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            span = dict(attrs).get("colspan") or "1"
            self.cell, self.span = [], min(SPAN, int(span)) if span.isdigit() and int(span) > 0 else 1

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == self.tag:
            self._close()
        elif tag in ("td", "th") and self.open and self.cell is not None:
            text = " ".join("".join(self.cell).split())[:CELL]
            if not self.open[-1]:
                self.open[-1].append([])
            self.open[-1][-1].extend([text] * self.span)
            self.cell = None
        elif tag == "table" and self.open:
            self.tables.append(self.open.pop())

    def handle_data(self, data):
        if self.skip:
            return
        if self.cell is not None:
            self.cell.append(data)
        elif self.tag:
            self.buffer.append(data)

    def _close(self):
        text = " ".join("".join(self.buffer).split())
        if self.tag == "title":
            self.title = self.title or text
        elif self.tag in ("h2", "h3", "h4"):
            self.heading = text[:160]
        elif (self.tag == "p" and len(text) > 40) or (self.tag == "li" and len(text) >= 2 and self.blocks):
            self.blocks.append((self.heading, self.tag, text))
        self.tag, self.buffer = "", []


def read(html: str | None) -> _Reader:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader._close()
    return reader


def grid(rows: list[list[str]]) -> list[list[str]] | None:
    """Rectangular grid of a table, or None if it is too small."""
    rows = [r[:COLUMNS] for r in rows if any(r)][:ROWS]
    width = max(map(len, rows), default=0)
    if len(rows) < 2 or width < 2 or sum(bool(c) for r in rows for c in r) < 3:
        return None
    return [r + [""] * (width - len(r)) for r in rows]


def article(pages: DataFrame) -> DataFrame:
    """(page_id, title, n_segments, n_chars, body): paragraphs over 40 characters, list items as bullets, boilerplate left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page_id, html in zip(frame["page_id"], frame["html"], strict=True):
                r = read(html)
                body = "\n".join(("• " if tag == "li" else "") + text for _, tag, text in r.blocks)
                rows.append((page_id, r.title, len({h for h, _, _ in r.blocks}), len(body), body))
            yield pd.DataFrame(rows, columns=["page_id", "title", "n_segments", "n_chars", "body"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, n_segments int, n_chars int, body string")


def tables(pages: DataFrame) -> DataFrame:
    """(page_id, ordinal, n_rows, n_cols, cells) of each table that is large enough."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page_id, html in zip(frame["page_id"], frame["html"], strict=True):
                grids = [g for g in map(grid, read(html).tables) if g]
                rows += [(page_id, k, len(g), len(g[0]), g) for k, g in enumerate(grids)]
            yield pd.DataFrame(rows, columns=["page_id", "ordinal", "n_rows", "n_cols", "cells"])

    return pages.select("page_id", "html").where(F.col("html").contains("<table")).mapInPandas(run, "page_id long, ordinal int, n_rows int, n_cols int, cells array<array<string>>")
