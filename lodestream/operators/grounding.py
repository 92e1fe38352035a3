"""Grounding: which names, figures and absolute claims of an analysis its source supports, and which targets.

Names are looked for with one automaton over all terms, built once a worker and
run over Arrow batches of texts. A list of terms goes to the tasks while its size
allows it; a longer one is cut into parts, with one pass over the texts a part.
Claims about targets are judged by columns alone: a value counts where a word of
the trade stands within ``REACH`` characters of it inside its sentence.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.scalar import bound

# Names that an analysis may use only if its source does; the last field keeps the case.
ENTITIES = [
    (name, term, term == "Fed")
    for name, terms in {
        "Federal Reserve": ["federal reserve", "fomc", "powell", "Fed", "美联储", "联邦公开市场委员会", "鲍威尔"],
        "ECB": ["ecb", "european central bank", "欧洲央行", "欧央行"],
        "Bank of England": ["bank of england", "boe", "英国央行", "英格兰银行"],
        "Bank of Japan": ["bank of japan", "boj", "日本央行", "日本银行"],
        "People's Bank of China": ["people's bank of china", "peoples bank of china", "pboc", "中国人民银行", "中国央行"],
        "IMF": ["imf", "international monetary fund", "国际货币基金组织"],
        "OPEC": ["opec", "欧佩克", "石油输出国组织"],
        "World Bank": ["world bank", "世界银行"],
    }.items()
    for term in terms
]
# Claims without a hedge, by the pattern they belong to.
CERTAINTY = [
    *[("will", f"will {w}", False) for w in ("definitely", "certainly", "surely")],
    ("guaranteed", "is guaranteed", False), ("doubt", "without a doubt", False), ("chance", "no chance", False),
    *[("always", f"{a} {b}", False) for a, b in itertools.product(("always", "never"), ("lead", "leads", "result", "results", "end", "ends"))],
    *[("zh", w, False) for w in ("必将", "势必", "一定会", "毫无疑问", "必然会", "肯定会")],
]
# Lines of a publisher's page that are no analysis.
BOILERPLATE = [
    *[("page", w, False) for w in (
        "for informational purposes only", "past performance not guarantee", "all rights reserved", "subscribe", "sign up", "cookie policy", "privacy policy", "terms of use", "advertisement",
        "sponsored content", "follow us", "share this article", "仅供参考", "过往表现不代表未来", "版权所有", "订阅", "广告", "隐私政策", "使用条款", "关注我们", "分享本文")],
    *[("page", f"does not constitute {a}{b}", False) for a, b in itertools.product(("", "a ", "an "), ("offer", "advice", "recommendation"))],
    *[("page", f"past performance {i}not {a}{b}", False) for i, a, b in itertools.product(("", "is "), ("", "a "), ("guarantee", "indicator"))],
    *[("page", f"不构成{i}{k}{w}", False) for i, k, w in itertools.product(("", "任何"), ("", "投资"), ("建议", "要约", "推荐"))],
]
#: Bytes of terms that go to every task.
MOST_BYTES = 16 << 20
REACH = 100

_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def ascii_lower(text: str) -> str:
    """A-Z lower-cased; every character keeps its place."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


class Matcher:
    """All terms of a list in one automaton. A term that begins (ends) with a-z, 0-9 or _ must not touch another such character there."""

    def __init__(self, terms: list[tuple[str, str, bool]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        by: dict[str, list[tuple[str, str, bool]]] = {}
        for name, term, exact in terms:
            if term:
                by.setdefault(ascii_lower(term), []).append((name, term, exact))
        for low, own in by.items():
            self.automaton.add_word(low, (len(low), own))
        if by:
            self.automaton.make_automaton()
        self.empty = not by

    def find(self, text: str) -> Iterator[tuple[str, int, int]]:
        """(name, start, end) of every mention, in the order of their ends."""
        if self.empty or not text:
            return
        low = ascii_lower(text)
        for last, (size, own) in self.automaton.iter(low):
            a, b = last + 1 - size, last + 1
            if (low[a] in _WORD and a and low[a - 1] in _WORD) or (low[last] in _WORD and b < len(low) and low[b] in _WORD):
                continue
            for name, term, exact in own:
                if not exact or text[a:b] == term:
                    yield name, a, b


def mentions(rows: DataFrame, keys: list[str], text: str, terms: list[tuple[str, str, bool]]) -> DataFrame:
    """(keys..., term, n, first): each name that a text mentions, how often, and where it begins first; null texts mention nothing."""
    parts = list(_parts(terms))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def job(part: list[tuple[str, str, bool]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(part)
            for batch in batches:
                at, names, n, first = [], [], [], []
                for k in range(batch.num_rows):
                    found: dict[str, list[int]] = {}
                    for name, a, _ in matcher.find(batch.column(text)[k].as_py() or ""):
                        mine = found.setdefault(name, [0, a])
                        mine[0] += 1
                    for name, (count, a) in found.items():
                        at.append(k)
                        names.append(name)
                        n.append(count)
                        first.append(a)
                place = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(place) for c in keys], pa.array(names, pa.string()), pa.array(n, pa.int64()), pa.array(first, pa.int64())], [*keys, "term", "n", "first"])

        return rows.select(*keys, text).mapInArrow(run, f"{kinds}, term string, n long, first long")

    out = job(parts[0])
    for part in parts[1:]:
        out = out.unionByName(job(part))
    if len(parts) == 1:
        return out
    return out.groupBy(*keys, "term").agg(F.sum("n").alias("n"), F.min("first").alias("first"))  # names with terms in several parts


def _parts(terms: list[tuple[str, str, bool]], most: int = MOST_BYTES) -> Iterator[list[tuple[str, str, bool]]]:
    part, size = [], 0
    for t in terms:
        n = len(t[0]) + len(t[1].encode()) + 64
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += n
    yield part


# --- analyses -------------------------------------------------------------------------------------

_DATES = re.compile(r"\b\d{4}-\d{1,2}-\d{1,2}\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b\d{4}/\d{1,2}/\d{1,2}\b", re.A)
# Spellings of the two units.
_UNITS = [(re.compile(r"percentage\s?points?|per\s?cent(?:age)?|percent|pct|百分点", re.I), "%"), (re.compile(r"basis\s?points?|bps?\b|个?基点", re.I), "bps")]
_FIGURE = re.compile(r"([0-9][0-9,]*(?:\.[0-9]+)?)\s?(%|bps)?", re.I)
_YEAR = re.compile(r"(?:19|20|21)[0-9]{2}")


def plain(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).split())


def figures(text: str) -> list[tuple[str, str]]:
    """(as written, magnitude) of the figures worth checking: no dates, no bare years, no bare digits; units are one spelling each."""
    text = _DATES.sub(" ", text)
    for spelling, unit in _UNITS:
        text = spelling.sub(unit, text)
    out = []
    for number, unit in _FIGURE.findall(text):
        number, unit = number.replace(",", ""), unit.lower()
        if (len(number) > 1 or unit) and not (not unit and _YEAR.fullmatch(number)):
            whole, _, part = number.partition(".")
            part = part.rstrip("0")
            out.append((number + unit, (whole.lstrip("0") or "0") + (f".{part}" if part else "")))
    return out


def _lead(text: str) -> str:
    return re.split(r"(?<=[.!?。！？])\s+", plain(text), maxsplit=1)[0].rstrip(".…").lower()


class Judge:
    """Issues of one analysis against its source."""

    def __init__(self, assets: dict[str, list[str]] | None = None):
        self.assets = assets or {}
        self.entities, self.certain, self.boilerplate = Matcher(ENTITIES), Matcher(CERTAINTY), Matcher(BOILERPLATE)
        self.aliases = Matcher([(t, a, False) for t, own in self.assets.items() for a in own])
        self.tickers = Matcher([(t, t, True) for t in self.assets])

    def issues(self, source: str, fields: dict[str, str]) -> list[tuple[str, str, str]]:
        """(code, field, detail), each once, by field; figures are checked in fields whose name does not end in ``_zh``."""
        src = plain(source)
        known = {m for _, m in figures(src)}
        named = {n for n, _, _ in self.entities.find(src)}
        claims = {n for n, _, _ in self.certain.find(src)}
        years = set(re.findall(r"\b(?:19|20|21)\d{2}\b", source, re.A))
        out: list[tuple[str, str, str]] = []
        given = {f: plain(v) for f, v in fields.items() if v and v.strip()}
        for field, text in given.items():
            if not field.endswith("_zh"):
                out += [("number_unsupported", field, as_written) for as_written, m in figures(text) if m not in known]
        for field, text in given.items():
            out += [("entity_unsupported", field, n) for n, _, _ in self.entities.find(text) if n not in named]
            first = {}
            for n, a, b in self.certain.find(text):
                first.setdefault(n, text[a:b])
            out += [("certainty_upgrade", field, said) for n, said in first.items() if n not in claims]
        every = " ".join(given.values())
        meant = {n for n, _, _ in self.aliases.find(src)}
        out += [("entity_unsupported", "assets", t) for t in self.assets if t not in meant and any(n == t for n, _, _ in self.tickers.find(every))]
        if "summary" in given:
            said, lead = given["summary"].rstrip(".…").lower(), _lead(source)
            if min(len(said), len(lead)) >= 40 and (said == lead or len(said) >= 80 and (lead.startswith(said) or said.startswith(lead))):
                out.append(("summary_copies_source_lead", "summary", lead[:120]))
        for field, text in given.items():
            if any(self.boilerplate.find(text)):
                out.append(("boilerplate_in_analysis", field, text[:120]))
            out += [("forecast_year_unsupported", field, y) for y in re.findall(r"\b(?:19|20|21)\d{2}\b", text, re.A) if y not in years]
        return list(dict.fromkeys(out))


def analysis_issues(rows: DataFrame, key: str, source: str, fields: list[str], assets: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, issues, score): what of an analysis its source does not support; the score falls by 0.12 an issue, to 0 at least.

    ``assets`` maps tickers to the aliases that name them in a source. Null fields claim nothing, a null source supports nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(assets)
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                cells = {f: batch.column(f)[k].as_py() for f in fields}
                found.append([dict(zip(("code", "field", "detail"), i, strict=True)) for i in judge.issues(batch.column(source)[k].as_py() or "", cells)])
            kind = pa.list_(pa.struct([("code", pa.string()), ("field", pa.string()), ("detail", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, kind)], [key, "issues"])

    kind = rows.schema[key].dataType.simpleString()
    judged = rows.select(key, source, *fields).mapInArrow(run, f"{key} {kind}, issues array<struct<code:string,field:string,detail:string>>")
    return judged.select(key, "issues", F.round(F.greatest(F.lit(0.0), 1 - F.size("issues") * F.lit(0.12)), 2).alias("score"))


# --- targets --------------------------------------------------------------------------------------

# Words of the trade, units, and the unit that a stored target is in.
_CUE = "(?i)(target|price objective|forecast)"
_UNIT = r"[$€£¥]|\b(usd|eur|gbp|jpy|cny|rmb|dollars?|euros?|pounds?|yen|yuan|per (share|barrel|ounce|tonne|metric ton))\b"
_DOLLAR = r"[$]|\b(usd|u\.s\. dollars?|dollars?)\b"


def number_forms(value: Column) -> Column:
    """Pattern of how a value may be written: plain, or with commas between thousands."""
    text = F.regexp_replace(F.regexp_replace(value.cast("decimal(30,10)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    whole, part = F.regexp_extract(text, r"^-?\d+", 0), F.regexp_extract(text, r"\.\d+$", 0)
    grouped = F.reverse(F.regexp_replace(F.reverse(whole), r"(\d{3})(?=\d)", "$1,"))
    return F.concat(F.lit("("), F.regexp_replace(F.concat(whole, part, F.lit("|"), grouped, part), r"([.])", r"\\$1"), F.lit(")"))


def target_context(source: Column, value: Column) -> Column:
    """The stretch of a sentence that states a value as a target: from the word of the trade to ``REACH`` characters behind the value, or the other way round; null without one."""
    def contexts(between: Column, said: Column) -> Column:
        def around(i: Column) -> Column:
            left = F.regexp_extract(F.right(between[i], F.lit(REACH + 20)), r"[^.!?\n]*$", 0)
            right = F.regexp_extract(between[i + 1], rf"^[^.!?\n]{{0,{REACH}}}", 0)
            # The word may stand REACH characters ahead of the value at most, not counting itself.
            cue = F.regexp_extract(left, rf"{_CUE}[^.!?\n]{{0,{REACH}}}$", 0)
            behind = F.regexp_extract(between[i + 1], rf"^([^.!?\n]{{0,{REACH}}}?)(?i)(target|price objective|forecast)[^.!?\n]{{0,{REACH}}}", 0)
            return bound(cue, lambda c: F.struct(F.when(c != "", F.concat(c, said[i], right)).alias("ahead"), bound(behind, lambda c: F.when(c != "", F.concat(said[i], c))).alias("behind")))

        first = lambda acc, x: F.struct(*[F.coalesce(acc[side], x[side]).alias(side) for side in ("ahead", "behind")])
        none = F.struct(F.lit(None).cast("string").alias("ahead"), F.lit(None).cast("string").alias("behind"))
        found = F.transform(F.sequence(F.lit(0), F.size(said) - 1), around)
        return F.when(F.size(said) > 0, F.aggregate(found, none, first, lambda acc: F.coalesce(acc["ahead"], acc["behind"])))

    cut = lambda forms: F.struct(F.split(source, forms).alias("between"), F.regexp_extract_all(source, forms, F.lit(1)).alias("said"))
    return bound(number_forms(value), lambda forms: bound(cut(forms), lambda b: contexts(b["between"], b["said"])))


def horizon_supported(horizon: Column, source: Column) -> Column:
    """Whether a source states a horizon: word for word, as its number of months, or as its year."""
    fold = lambda c: F.trim(F.lower(F.regexp_replace(c, r"[\s\x{A0}]+", " ")))
    value, text = fold(horizon), fold(source)
    months = F.regexp_extract(value, r"^(\d+)\s*(m|month|months)$", 1)
    year = F.regexp_extract(value, r"(20\d{2})", 1)
    spelled = F.when(months != "", F.rlike(text, F.concat(F.lit(r"\b"), months, F.lit(r"[- ]?months?\b"))))
    dated = F.when(year != "", F.rlike(text, F.concat(F.lit(r"\b"), year, F.lit(r"\b"))))
    return (value != "") & (value != "unspecified") & (F.contains(text, value) | F.coalesce(spelled, dated, F.lit(False)))


def supported_claims(claims: DataFrame, source: str = "source") -> DataFrame:
    """``claims(..., ticker, target, previous_target, horizon, source)`` with unsupported values cleared, and ``issues``.

    A target without a horizon, or with one that the source does not state, is cleared; so is a value that no sentence
    states as a target, one without a unit, and one in another unit than dollars. Issues are (code, field, detail).
    """
    src = F.coalesce(F.col(source), F.lit(""))
    horizon = F.nullif(F.trim("horizon"), F.lit(""))
    tried = F.col("target").isNotNull() | F.col("previous_target").isNotNull()
    stated = horizon_supported(horizon, src)
    rows = claims.withColumn("_h", F.when(tried & horizon.isNull(), "forecast_horizon_missing").when(horizon.isNotNull() & ~stated, "forecast_horizon_unsupported"))
    issue = lambda code, field, detail: F.struct(code.alias("code"), F.lit(field).alias("field"), detail.alias("detail"))
    found = [F.when(F.col("_h").isNotNull(), issue(F.col("_h"), "horizon", F.coalesce(horizon, F.col("ticker"))))]
    for name in ("target", "previous_target"):
        context = F.col(f"_{name}")
        low = F.lower(context)
        code = F.when(F.col("_h").isNotNull() | F.col(name).isNull(), F.lit(None).cast("string")).when(context.isNull(), "forecast_target_unsupported").when(~low.rlike(_UNIT), "forecast_unit_missing").when(~low.rlike(_DOLLAR), "forecast_unit_unsupported")
        rows = rows.withColumn(f"_{name}", F.when(F.col("_h").isNull() & F.col(name).isNotNull(), target_context(src, F.col(name)))).withColumn(f"_{name}_code", code)
        found.append(F.when(F.col(f"_{name}_code").isNotNull(), issue(F.col(f"_{name}_code"), name, F.coalesce(F.left(context, F.lit(120)), F.col(name).cast("string")))))
    keep = lambda c: F.when(F.col("_h").isNull() & F.col(f"_{c}_code").isNull(), F.col(c)).alias(c)
    names = {"target": keep("target"), "previous_target": keep("previous_target"), "horizon": F.when(F.coalesce(F.col("_h") == "forecast_horizon_unsupported", F.lit(False)), None).otherwise(horizon).alias("horizon")}
    return rows.select(*[names.get(c, F.col(c)) for c in claims.columns], F.array_compact(F.array(*found)).alias("issues"))
