"""Release schedules on publishers' pages: table rows with spans carried down, and panels of meetings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.scalar import local_to_utc

MONTHS = "january february march april may june july august september october november december".split()
# Names of classes and columns of the two pages.
TITLE, DATE, TIME = ("release-title", "release"), ("release-date", "date"), ("small", "time")
PANEL, HEADING, MEETING, MONTH, DAYS = "panel", "panel-heading", "fomc-meeting", "fomc-meeting__month", "fomc-meeting__date"
#: Rows and columns that a span reaches at most.
SPAN = 200


@dataclass
class Cell:
    text: str = ""
    header: bool = False
    rows: int = 1
    columns: int = 1
    marks: dict[str, str] = field(default_factory=dict)


def _squeezed(text: str) -> str:
    return " ".join(text.split())


class _Page(HTMLParser):
    """Tables of cells, and the marked texts of panels. What an element of a class says stands under that class."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[Cell]]] = []
        self.panels: list[tuple[str, list[dict[str, str]]]] = []
        self.stack: list[tuple[str, list[str]]] = []
        self.open: list[list[list[Cell]]] = []
        self.cells: list[Cell] = []

    def handle_starttag(self, tag, attrs):
        of = dict(attrs)
        classes = (of.get("class") or "").split()
        if tag == "table":
            self.open.append([])
            self.tables.append(self.open[-1])
        elif tag == "tr" and self.open:
            self._leave({"td", "th", "tr"})
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            self._leave({"td", "th"})
            if not self.open[-1]:
                self.open[-1].append([])
            span = lambda name: min(SPAN, int(of[name])) if (of.get(name) or "").isdigit() and int(of[name]) else 1
            self.cells.append(Cell(header=tag == "th", rows=span("rowspan"), columns=span("colspan")))
            self.open[-1][-1].append(self.cells[-1])
        if PANEL in classes:
            self.panels.append(("", []))
        if MEETING in classes and self.panels:
            self.panels[-1][1].append({})
        if tag not in ("br", "img", "hr", "meta", "link", "input"):
            self.stack.append((tag, classes))
        elif tag == "br":
            self.handle_data(" ")

    def _leave(self, tags: set[str]) -> None:
        """Close cells and rows of the innermost table that the page leaves open."""
        inner = max((k for k, (t, _) in enumerate(self.stack) if t == "table"), default=-1)
        at = next((k for k in range(inner + 1, len(self.stack)) if self.stack[k][0] in tags), len(self.stack))
        while len(self.stack) > at:
            if self.stack.pop()[0] in ("td", "th") and self.cells:
                self.cells.pop()

    def handle_endtag(self, tag):
        if tag not in [t for t, _ in self.stack]:
            return
        while self.stack:
            shut = self.stack.pop()[0]
            if shut in ("td", "th") and self.cells:
                self.cells.pop()
            if shut == "table" and self.open:
                self.open.pop()
            if shut == tag:
                break

    def handle_data(self, data):
        tags = [t for t, _ in self.stack]
        if "script" in tags or "style" in tags:
            return
        marks = {c for t, classes in self.stack for c in (t, *classes)}
        if self.cells:
            self.cells[-1].text += data
            for m in marks:
                self.cells[-1].marks[m] = self.cells[-1].marks.get(m, "") + data
        if self.panels:
            heading, meetings = self.panels[-1]
            if HEADING in marks and not meetings:
                self.panels[-1] = (heading + data, meetings)
            elif MEETING in marks and meetings:
                for m in marks & {MONTH, DAYS}:
                    meetings[-1][m] = meetings[-1].get(m, "") + data


def _page(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def spread(table: list[list[Cell]]) -> list[list[Cell | None]]:
    """A table as a grid: a cell stands in every row and column that it spans."""
    grid: list[list[Cell | None]] = [[] for _ in table]
    for r, row in enumerate(table):
        c = 0
        for cell in row:
            while c < len(grid[r]) and grid[r][c] is not None:
                c += 1
            for down in range(r, min(r + cell.rows, len(table))):
                grid[down] += [None] * (c + cell.columns - len(grid[down]))
                grid[down][c : c + cell.columns] = [cell] * cell.columns
            c += cell.columns
    return grid


def table_rows(html: str | None) -> list[dict[str, str]]:
    """Rows of all tables: texts by the class of what says them, and by the header above their column (lower case)."""
    out = []
    for table in _page(html).tables:
        header: dict[int, str] = {}
        for row in spread(table):
            if row and all(c is None or c.header for c in row):
                header = {k: _squeezed(c.text).lower() for k, c in enumerate(row) if c is not None}
                continue
            said: dict[str, str] = {}
            for k, cell in enumerate(row):
                if cell is not None:
                    said |= {m: _squeezed(t) for m, t in cell.marks.items()}
                    said.setdefault(header.get(k, f"#{k}"), _squeezed(cell.text))
            out.append(said)
    return out


def clock(text: str) -> str | None:
    """``8:30 a.m.`` as 08:30."""
    m = re.search(r"\b(\d{1,2}):(\d{2})\s*([ap])\.?\s?m\b", text, re.I)
    if not m or not 1 <= int(m[1]) <= 12 or int(m[2]) > 59:
        return None
    return f"{int(m[1]) % 12 + 12 * (m[3].lower() == 'p'):02}:{m[2]}"


#: (family, aliases, default local time): a title belongs to the first family with an alias in it.
Families = list[tuple[str, list[str], str | None]]


def listed_releases(html: str | None, year: int, families: Families) -> list[tuple[str, str, str]]:
    """(family, id, local time) of the rows that name a release of a family, a month and day, and a time (or the family's)."""
    out = []
    for row in table_rows(html):
        say = lambda names: next((row[n] for n in names if row.get(n)), "")
        title, date = say(TITLE), re.fullmatch(r"([A-Za-z]+)\s+(\d{1,2})", say(DATE))
        found = next(((f, t) for f, aliases, t in families if any(a.lower() in title.lower() for a in aliases)), None)
        if not found or not date or date[1].lower() not in MONTHS:
            continue
        time = clock(say(TIME)) or found[1]
        if time:
            name = re.sub("[^a-z0-9]+", "-", title.lower()).strip("-")
            out.append((found[0], f"{found[0]}:{name}", f"{year}-{MONTHS.index(date[1].lower()) + 1:02}-{int(date[2]):02}T{time}:00"))
    return out


def panel_meetings(html: str | None, family: str, time: str) -> list[tuple[str, str, str]]:
    """(family, id, local time) of the last day of each meeting in panels headed by a year; months and days may be spans."""
    out = []
    for heading, meetings in _page(html).panels:
        year = re.search(r"\b(20\d\d)\s+FOMC Meetings", _squeezed(heading), re.I)
        for k, m in enumerate(meetings if year else []):
            month = _squeezed(m.get(MONTH, "")).lower().rpartition("/")[2]
            day = _squeezed(m.get(DAYS, "")).replace("*", "").strip().rpartition("-")[2]
            if month in MONTHS and day.isdigit():
                out.append((family, f"{family}:{year[1]}:{k + 1}", f"{year[1]}-{MONTHS.index(month) + 1:02}-{int(day):02}T{time}:00"))
    return out


def schedules(pages: DataFrame, key: str, kind: Column, zone: str, families: Families, meetings: tuple[str, str]) -> DataFrame:
    """``pages(key, html, year)`` -> (key, family, release_id, local_time, scheduled_at): ``kind`` is ``table`` or ``panels``.

    Times are of ``zone``; one that its clock skips, or a day that no month has, is null in ``scheduled_at``.
    """
    named = pages.select(key, "html", "year", kind.alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, (html, year, shape) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("html", "year", "kind")], strict=True)):
                found = listed_releases(html, year, families) if shape == "table" else panel_meetings(html, *meetings)
                rows += [(k, *f) for f in found]
            cells = [pa.array([r[k] for r in rows], pa.string()) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array([r[0] for r in rows], pa.int32())), *cells], [key, "family", "release_id", "local_time"])

    found = named.mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, family string, release_id string, local_time string")
    return found.withColumn("scheduled_at", local_to_utc(F.col("local_time"), zone))
