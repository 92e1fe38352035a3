"""Structure of article texts: parts and batches, dates in addresses and titles, disclaimers, blocks.

Each works on one text at a time inside Arrow batches, so a job needs no shuffle
and holds one batch.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame

# --- parts and batches ----------------------------------------------------------------------------

MOST = 6000
_FIGURE = re.compile(r"(?:[$€£¥]\s*)?[+-]?\d[\d,]*(?:\.\d+)?(?:\s?%|\s?(?:bps?|basis points?))?", re.I)


def spans(text: str, most: int = MOST, boundary: str = r"\n\s*\n") -> list[tuple[int, int]]:
    """Start and end of the parts of a text, each of at most ``most`` characters.

    A text within the limit is one part. Paragraphs are taken in order into a part while they fit with the boundaries
    between them; one beyond the limit is cut into pieces of the limit and shares no part. What lies between parts is
    boundaries only, so parts and the text between them give the text back. An empty text is one empty part.
    """
    if len(text) <= most:
        return [(0, len(text))]
    edges = [m.span() for m in re.finditer(boundary, text)]
    paragraphs = [(a, b) for a, b in zip([0, *[e for _, e in edges]], [*[s for s, _ in edges], len(text)], strict=True) if b > a]
    out: list[tuple[int, int]] = []
    open_: tuple[int, int] | None = None
    for a, b in paragraphs:
        if open_ is not None and b - open_[0] <= most:
            open_ = (open_[0], b)
            continue
        if open_ is not None:
            out.append(open_)
        open_ = (a, b) if b - a <= most else None
        if open_ is None:
            out += [(at, min(at + most, b)) for at in range(a, b, most)]
    return out + ([open_] if open_ is not None else [])


def packed(sizes: list[int], most: int = MOST) -> list[int]:
    """Batch number of each part: parts join the open batch while their sum stays within the limit."""
    out, batch, total = [], 0, 0
    for k, size in enumerate(sizes):
        if k and total + size > most:
            batch, total = batch + 1, 0
        total += size
        out.append(batch)
    return out


def kept_verbatim(text: str) -> bool:
    """A table (eight figures and more, a sentence to three at most, three words each at most) or a short contact block."""
    numbers, sentences = len(_FIGURE.findall(text)), len(re.findall(r"[.!?](?:\s|$)", text))
    if numbers and len(text) <= 800 and sentences <= 1 and re.search(r"\b(?:tel|phone|fax|email)\b|@", text, re.I):
        return True
    words = len(re.findall(r"[A-Za-z][A-Za-z'-]*", text))
    return numbers >= 8 and sentences < -(-numbers // 3) and words <= 3 * numbers


PART = [("part", pa.int32()), ("batch", pa.int32()), ("begins", pa.int32()), ("ends", pa.int32()), ("verbatim", pa.bool_()), ("piece", pa.string())]


def parts(rows: DataFrame, key: str, text: str, most: int = MOST, boundary: str = r"\n\s*\n") -> DataFrame:
    """(key, part, batch, begins, ends, verbatim, piece): the parts of each text with the batch that each is sent in; null texts have none."""

    def of(value: str) -> list[tuple]:
        cut = spans(value, most, boundary)
        batches = packed([b - a for a, b in cut], most)
        return [(k, n, a, b, kept_verbatim(value[a:b]), value[a:b]) for k, ((a, b), n) in enumerate(zip(cut, batches, strict=True))]

    return each_text(rows, key, text, of, PART)


def each_text(rows: DataFrame, key: str, text: str, of: Callable[[str], list[tuple]], columns: list[tuple[str, pa.DataType]]) -> DataFrame:
    """(key, columns...) of what ``of`` gives for each text that is not null."""
    names = {pa.int32(): "int", pa.bool_(): "boolean", pa.string(): "string", pa.date32(): "date"}
    kinds = ", ".join([f"{key} {rows.schema[key].dataType.simpleString()}", *[f"{n} {names[t]}" for n, t in columns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            out: list[list] = [[] for _ in columns]
            for k in range(batch.num_rows):
                value = batch.column(text)[k].as_py()
                for row in of(value) if value is not None else ():
                    at.append(k)
                    for cell, column in zip(row, out, strict=True):
                        column.append(cell)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int32())), *[pa.array(v, t) for v, (_, t) in zip(out, columns, strict=True)]], [key, *[n for n, _ in columns]])

    return rows.select(key, text).mapInArrow(run, kinds)


# --- dates ----------------------------------------------------------------------------------------

_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_LONG = "january february march april may june july august september october november december".split()
_Y4, _Y2, _M2, _M, _D2, _D = r"(?P<Y>20\d\d)", r"(?P<y>\d\d)", r"(?P<M>0[1-9]|1[0-2])", r"(?P<m>0?[1-9]|1[0-2])", r"(?P<D>0[1-9]|[12]\d|3[01])", r"(?P<d>[12]\d|3[01]|0?[1-9])"
_NAME, _NTH, _GAP, _END, _NEW = rf"(?P<N>{'|'.join([*_LONG, 'sept', *_MONTHS])})\.?", "(?:st|nd|rd|th)?", r"[-_\s]+", r"(?!\d)", r"(?:^|[-_/\s])"
# The shapes in the order of their rank; the last groups are read only when nothing above fits. "six" is six digits.
_shapes = lambda *shapes: [s if s == "six" else re.compile(s, re.I) for s in shapes]
DAY_SHAPES = _shapes(
    rf"(?<!\d){_Y4}{_M2}{_D2}{_END}", rf"{_Y4}[-_/]{_M}[-_/]{_D}{_END}", rf"(?:q(?P<q>[1-4])|(?P<Q>[1-4])q)[\s_-]*(?:20)?{_Y2}{_END}", rf"(?<!\d){_D}\.{_M}\.{_Y4}{_END}", rf"{_NEW}{_D2}{_M2}{_Y4}{_END}", "six",
    rf"(?<![a-z]){_NAME}{_GAP}{_D}{_NTH},?{_GAP}{_Y4}", rf"(?<!\d){_D}{_NTH}{_GAP}{_NAME},?{_GAP}{_Y4}",
)
YEARLESS_SHAPES = _shapes(rf"(?<![a-z]){_NAME}{_GAP}{_D}{_NTH}{_END}", rf"(?<!\d){_D}{_NTH}{_GAP}{_NAME}(?![a-z])")
MONTH_SHAPES = _shapes(rf"\(\s*{_NAME},?\s*{_Y4}\s*\)")
_SIX = re.compile(r"(?:^|[-_/\s])(\d\d)(\d\d)(\d\d)(?!\d)")


def _date(found: re.Match, year: int | None = None) -> dt.date | None:
    of = found.groupdict()
    year = year or int(of.get("Y") or 2000 + int(of["y"]))
    if quarter := of.get("q") or of.get("Q"):
        return dt.date(year, 3 * int(quarter) - 2, 1)
    month = _MONTHS.index(of["N"][:3].lower()) + 1 if of.get("N") else int(of.get("M") or of["m"])
    try:
        return dt.date(year, month, int(of.get("D") or of.get("d") or 1))
    except ValueError:
        return None


def _six(text: str, last: dt.date) -> dt.date | None:
    """Six digits: day or year first, whichever reading is the later one that has come."""
    found = _SIX.search(text)
    if not found:
        return None
    a, b, c = map(int, found.groups())
    readings = []
    for year, day in ((c, a), (a, c)):
        try:
            readings.append(dt.date(2000 + year, b, day))
        except ValueError:
            pass
    return max((r for r in readings if r <= last), default=None)


def publication_date(values: list[str | None], today: dt.date) -> dt.date | None:
    """The date that addresses and titles tell, by the first shape that fits the first value that has any; never later than tomorrow.

    A day and month without a year take the year if all values together name one only; a month with its year in
    brackets is its first day. Percent escapes are decoded.
    """
    last = today + dt.timedelta(days=1)
    texts = [unquote(v) for v in values if v]
    ok = lambda d: d is not None and d <= last
    for text in texts:
        for shape in DAY_SHAPES:
            date = _six(text, last) if shape == "six" else (_date(m) if (m := shape.search(text)) else None)
            if ok(date):
                return date
    years = {y for t in texts for y in re.findall(r"\b20\d\d\b", t)}
    if len(years) == 1:
        for text in texts:
            for shape in YEARLESS_SHAPES:
                if (m := shape.search(text)) and ok(date := _date(m, int(next(iter(years))))):
                    return date
    for text in texts:
        for shape in MONTH_SHAPES:
            if (m := shape.search(text)) and ok(date := _date(m)):
                return date
    return None


def publication_dates(rows: DataFrame, key: str, values: list[str], today: dt.date) -> DataFrame:
    """(key, published) for every row, null where no value tells a date."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [batch.column(c).to_pylist() for c in values]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([publication_date(list(v), today) for v in zip(*cells, strict=True)], pa.date32())], [key, "published"])

    return rows.select(key, *values).mapInArrow(run, f"{key} {kind}, published date")


# --- disclaimers ----------------------------------------------------------------------------------

# How a disclaimer begins, and what its sentences say; a pair holds within 80 characters of a line.
OPENINGS = [r"this (content|material) is marketing material\b", r"(legal )?disclaimer\s*[:：]?\s*(?=\S)", "(本内容|本材料)(为|是)营销材料", r"(法律)?免责声明\s*[:：]?\s*(?=\S)"]
MARKERS = [
    ("for informational purposes only",), ("does not constitute", "offer|advice|recommendation"), ("past (investment )?performance", "future|guarantee"), ("accuracy|completeness", "not guaranteed|no guarantee"),
    ("(assumes?|accepts?) no liability",), ("does not meet", "research"), ("仅供参考|仅供信息参考",), ("不构成", "要约|建议|推荐"), ("过往表现", "未来|保证"), ("不保证", "准确|完整"), ("不(承担|负)", "责任"), ("不符合", "独立研究"),
]
LEGAL_HEADINGS = ["important (legal )?(information|notice)", "(legal )?disclaimers?", "免责声明", "重要(法律)?信息"]
RELATED_HEADINGS = ["explore the latest", "related (insights|articles|content)", "read (this )?next", "latest (market )?insights", "more (from|insights)", "recommended (for you|articles)"]
#: Characters of an article that come before a disclaimer at least.
LEAST = 120

_OPENING = re.compile("|".join(OPENINGS), re.I)
_MARKER = [re.compile(".{0,80}".join(f"(?:{p})" for p in m), re.I) for m in MARKERS]
_LEGAL, _RELATED = (re.compile(f"^(?:{'|'.join(h)})", re.I) for h in (LEGAL_HEADINGS, RELATED_HEADINGS))
_BREAK = re.compile(r"\n\s*\n")


def disclaimer_start(text: str) -> int | None:
    """Where a trailing disclaimer begins: at the first paragraph that opens like one, that holds two of its sentences, or
    that holds one and two more kinds follow. Paragraphs are read once, from the end."""
    breaks = [m.span() for m in _BREAK.finditer(text)]
    starts = [0, *[b for _, b in breaks]]
    ends = [*[a for a, _ in breaks], len(text)]
    found, later = None, set()
    for k in range(len(starts) - 1, -1, -1):
        own = {i for i, p in enumerate(_MARKER) if p.search(text, starts[k], ends[k])}
        later |= own
        if _OPENING.match(text, starts[k]):
            found = breaks[k - 1][0] if k else 0
        elif len(own) >= 2 or own and len(later) >= 3 and k:
            found = starts[k]
    return found


def split_disclaimer(text: str, before: int = 0) -> tuple[str, str | None]:
    """(body, disclaimer); ``before`` characters of the article came ahead of this text. A disclaimer that would begin an article is none."""
    start = disclaimer_start(text)
    if start is None or before + start < LEAST:
        return text, None
    return text[:start].strip(), text[start:].strip() or None


def partition_segments(segments: list[tuple[str | None, str]]) -> tuple[list[tuple[str | None, str]], str | None]:
    """Segments (heading, text) of the body, and the disclaimer: body until a heading of related articles, then only a disclaimer
    is looked for; a heading of legal notices, or a text that turns into one, ends both."""
    body: list[tuple[str | None, str]] = []
    size, over = 0, False
    for heading, text in segments:
        title = (heading or "").strip()
        if _RELATED.match(title):
            over = True
            continue
        if (m := _LEGAL.match(title)) and (m.end() == len(title) or not re.match(r"\w", title[m.end()], re.A)):
            return body, text.strip() or None
        own, legal = split_disclaimer(text, size)
        if not over and own:
            body.append((heading, own))
            size += len(own)
        if legal:
            return body, legal
    return body, None


# --- blocks ---------------------------------------------------------------------------------------

#: Signs that open an item of a list.
BULLETS = "•·▪◦‣►▶▸–—*+-"


def blocks(text: str) -> list[tuple[str, list[str]]]:
    """("paragraph", [line]) and ("list", items): each line is a paragraph, items that follow each other are one list."""
    out: list[tuple[str, list[str]]] = []
    for line in (x.strip() for x in text.split("\n")):
        sign = line[:1] in BULLETS and line[1:2].isspace() if line else False
        line = line[1:].strip() if sign else line
        if not line:
            continue
        if sign and out and out[-1][0] == "list":
            out[-1][1].append(line)
        else:
            out.append(("list" if sign else "paragraph", [line]))
    return out


BLOCK = [("section", pa.string()), ("block", pa.int32()), ("kind", pa.string()), ("item", pa.int32()), ("line", pa.string())]


def structured(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, block, kind, item, line) of each text: blocks of its body, then of its disclaimer."""

    def of(value: str) -> list[tuple]:
        body, legal = split_disclaimer(value)
        return [(section, b, kind, i, line) for section, t in (("body", body), ("disclaimer", legal or "")) for b, (kind, items) in enumerate(blocks(t)) for i, line in enumerate(items)]

    return each_text(rows, key, text, of, BLOCK)
