"""Latin queries against Chinese names: full readings and initials, with characters of several readings.

A name is a row of units: a character with its readings, or a Latin run as it
is. Which readings a query takes is settled by a search over (unit, place in the
query), so no combination of readings is ever written out. The readings come
from a table; only those of characters that the names hold go to the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators.grounding import MOST_BYTES

_CHINESE = re.compile("[一-鿿]")
_UNIT = re.compile("[一-鿿]|[^一-鿿]+")
# Scores of a full reading (all, its beginning, a part of four letters and more) and of the initials (all, their beginning).
FULL, BEGINS, HOLDS, INITIALS, INITIALS_BEGIN = 96, 84, 62, 78, 58


def units(name: str, readings: dict[str, list[str]]) -> list[list[str]]:
    """What each character, and each run of others, may read; what has no letters or digits reads as nothing."""
    if not _CHINESE.search(name):
        return []
    plain = lambda t: re.sub("[^a-z0-9]", "", t.lower())
    out = [[plain(r) for r in readings.get(u, [""])] if _CHINESE.match(u) else [plain(u)] for u in _UNIT.findall(name.strip())]
    return [u for u in out if any(u)]


def _begins(query: str, rows: list[list[str]], anywhere: bool = False) -> bool:
    """Whether some reading of the units begins with the query; with ``anywhere``, whether one holds it."""
    places = {0}
    for unit in rows:
        after = set()
        for text in unit:
            starts = [(p, text) for p in places] + [(0, text[cut:]) for cut in range(1, len(text)) if anywhere]
            for place, rest in starts:
                left = query[place:]
                if rest.startswith(left):
                    return True
                if left.startswith(rest):
                    after.add(place + len(rest))
        places = after | ({0} if anywhere else set())
    return False


def _exact(query: str, rows: list[list[str]]) -> bool:
    places = {0}
    for unit in rows:
        places = {p + len(t) for p in places for t in unit if query.startswith(t, p)}
    return len(query) in places


def score(query: str, name: str, readings: dict[str, list[str]]) -> int:
    """How well a query spells a name; 0 for no match, for queries under two letters and for names without Chinese."""
    q = re.sub(r"\s+", "", query).lower()
    rows = units(name, readings)
    if len(q) < 2 or not rows:
        return 0
    if _exact(q, rows):
        return FULL
    if _begins(q, rows):
        return BEGINS
    if len(q) >= 4 and _begins(q, rows, True):
        return HOLDS
    first = [sorted({t[:1] for t in unit if t}) for unit in rows]
    if len(first) >= 2:
        if _exact(q, first):
            return INITIALS
        if _begins(q, first):
            return INITIALS_BEGIN
    return 0


def matches(names: DataFrame, key: str, name: str, queries: list[str], dictionary: DataFrame) -> DataFrame:
    """(key, query, score) of the names that a query spells, from ``dictionary(character, reading)``; null names match nothing."""
    held = names.select(F.explode(F.array_distinct(F.regexp_extract_all(name, F.lit("[一-鿿]"), F.lit(0)))).alias("character")).distinct()
    known = dictionary.join(held, "character", "left_semi").distinct()
    size = known.agg(F.sum(F.octet_length("reading") + 64)).first()[0] or 0
    if size > MOST_BYTES:  # there are some 21,000 such characters, of a few readings each
        raise ValueError(f"{size} bytes of readings: no dictionary of characters")
    readings: dict[str, list[str]] = {}
    for r in known.orderBy("character", "reading").collect():
        readings.setdefault(r["character"], []).append(r["reading"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, q, s) for k, n in enumerate(batch.column(name).to_pylist()) if n for q in queries if (s := score(q, n, readings))]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array([r[0] for r in rows], pa.int32())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], [key, "query", "score"])

    return names.select(key, name).mapInArrow(run, f"{key} {names.schema[key].dataType.simpleString()}, query string, score int")
