"""Column helpers whose exact rounding and null rules the queries rely on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest integer, halves toward plus infinity (so -2.5 gives -2)."""
    return F.floor(x + F.lit(0.5)).cast("long")


def half_even(x: Column) -> Column:
    """The nearest whole number, halves to the even one: CAST(x AS BIGINT) of a double in DuckDB."""
    return F.rint(x).cast("long")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, not at each use: Spark computes what a lambda mentions again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rate(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage, null when the whole is 0."""
    return F.when(whole != 0, F.round(part * F.lit(100.0) / whole, digits))


def change(now: Column, before: Column, digits: int = 1) -> Column:
    """Percentage change, null when there was nothing before."""
    return F.when(before != 0, F.round((now - before) * F.lit(100.0) / before, digits))


def strict_sum(x: Column) -> Column:
    """A sum that is null as soon as one value is null."""
    return F.when(F.count_if(x.isNull()) == 0, F.sum(x))


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson score interval; null without trials."""
    n, p = total.cast("double"), successes / total.cast("double")
    mid, root = p + F.lit(z * z) / (2 * n), F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n))
    low, high = (mid - root) / (1 + F.lit(z * z) / n), (mid + root) / (1 + F.lit(z * z) / n)
    return F.when(total > 0, F.greatest(F.lit(0.0), low)), F.when(total > 0, F.least(F.lit(1.0), high))


def visitor(key: Column, device: Column) -> Column:
    """Identity of a visitor: the key, else the device marked ``d:``."""
    return F.coalesce(key, F.concat(F.lit("d:"), device.cast("string")))


#: What feeds write where a number is missing, in lower case.
MISSING = ["", ".", "..", "-", "--", "---", "n/a", "na", "(na)", "nan", "none", "null"]


def decimal_string(text: Column) -> Column:
    """Number in a feed's text as plain decimal text, digit for digit: commas, unicode minus, parentheses for negatives, exponents.

    No exponent, no zeros that say nothing, no "-0"; null for missing tokens, for what is no number, and for exponents of
    four digits and more.
    """
    t = F.translate(F.trim(text), "−,\u00a0 ", "-")
    t = F.when(~F.lower(t).isin(*MISSING), t)
    t = F.when(t.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.regexp_extract(t, r"^\((.*)\)$", 1))).otherwise(t)
    form = r"^([+-]?)([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]{1,3}))?$"
    sign, whole, part = (F.regexp_extract(t, form, k) for k in (1, 2, 3))
    power = F.coalesce(F.regexp_extract(t, form, 4).try_cast("int"), F.lit(0))
    digits, point = F.concat(whole, part), F.length(whole) + power
    zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))
    left = F.when(point > 0, F.concat(F.substring(digits, F.lit(1), F.greatest(point, F.lit(0))), zeros(point - F.length(digits)))).otherwise("")
    right = F.when(point < 0, F.concat(zeros(-point), digits)).otherwise(F.substring(digits, F.greatest(point, F.lit(0)) + 1, F.length(digits)))
    left, right = F.regexp_replace(left, "^0+", ""), F.regexp_replace(right, "0+$", "")
    plain = F.concat(F.when(left == "", "0").otherwise(left), F.when(right == "", "").otherwise(F.concat(F.lit("."), right)))
    return F.when(t.rlike(form) & (digits != ""), F.concat(F.when((sign == "-") & (plain != "0"), "-").otherwise(""), plain))


def decimal_text(text: Column) -> Column:
    """:func:`decimal_string` as a decimal(38, 12); null, not a cut number, where that type cannot hold it."""
    t = decimal_string(text)
    return F.when(t.rlike(r"^-?[0-9]{1,26}(\.[0-9]{1,12})?$"), t.try_cast("decimal(38, 12)"))


def period_start(text: Column, frequency: Column | None = None) -> Column:
    """First day of a period written YYYY, YYYY-Qn, YYYY-MM, YYYY-Mnn or YYYY-MM-DD; null for anything else.

    Given a ``frequency``, a year counts for ANNUAL only, a quarter for QUARTERLY, a month for MONTHLY; days count for all.
    """
    t = F.upper(F.trim(text))
    year, rest = F.regexp_extract(t, r"^(\d{4})", 1), F.regexp_extract(t, r"^\d{4}-?(.*)$", 1)
    dashed = F.substring(t, 5, 1) == "-"
    of = lambda name: F.lit(True) if frequency is None else F.coalesce(frequency == name, F.lit(False))
    quarter, month = F.regexp_extract(rest, "^Q([1-4])$", 1).try_cast("int"), F.regexp_extract(rest, r"^M?(\d\d)$", 1)
    day = F.when(of("QUARTERLY") & quarter.isNotNull(), F.concat_ws("-", year, F.lpad((quarter * 3 - 2).cast("string"), 2, "0"), F.lit("01")))
    day = day.when(of("MONTHLY") & dashed & (month != ""), F.concat_ws("-", year, month, F.lit("01"))).when(of("ANNUAL") & (t == year), F.concat(t, F.lit("-01-01")))
    return day.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).try_cast("date")


#: Days of a unit, and days of the usual bands.
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "quarter": 91, "year": 365}
CODE_DAYS = {"w": 7, "m": 30, "q": 91, "y": 365}
BANDS = [(r"(near|short)[ _-]?term", 30), ("tactical", 30), (r"(short|near)[ _-]?to[ _-]?intermediate[ _-]?term", 60), (r"(medium|intermediate|mid)[ _-]?term", 90), (r"long[ _-]?term", 365), ("strategic", 365)]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def horizon_text(raw: Column) -> Column:
    """A horizon in lower case, without what is in brackets, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(raw), r"[(（].*?[)）]", " "), r"\s+", " "))


#: Kinds of the tokens of a horizon, one letter each; tokens of no kind and ``of``, ``the``, ``next`` say nothing.
_KINDS = [("Y", r"\d{4}"), ("n", r"\d+"), ("M", "|".join(MONTHS)), ("U", "|".join(f"{u}s?" for u in UNIT_DAYS)), ("c", "[wmqy]"), ("h", "h"), ("e", "end"), ("r", "remainder|rest"), ("-", "-|–|to")]


def horizon_tokens(t: Column) -> Column:
    """What :func:`horizon_end` reads of a horizon's text: its tokens, their kinds, the same without dashes, and whether other words stand there."""
    kind = lambda x: F.coalesce(*[F.when(x.rlike(f"^({p})$"), k) for k, p in _KINDS], F.lit(""))
    tokens = F.filter(F.regexp_extract_all(t, F.lit("([0-9]+|[a-z]+|[-–])"), F.lit(1)), lambda x: kind(x) != "")
    full = F.array_join(F.transform(tokens, kind), "")
    named = F.filter(tokens, lambda x: ~x.isin("-", "–", "to"))
    known = "|".join(p for _, p in _KINDS if p.isascii())
    quiet = ~F.regexp_replace(t, rf"\b({known}|of|the)\b", "").rlike("[a-z]{2}") & ~F.regexp_replace(t, rf"\b({known}|of|the)\b|[0-9]+[a-z][0-9]*|[a-z][0-9]+", "").rlike("[a-z]")
    return F.struct(tokens.alias("tokens"), full.alias("full"), named.alias("named"), F.replace(full, F.lit("-"), F.lit("")).alias("shape"), quiet.alias("quiet"))


def horizon_end(start: Column, t: Column, parsed: Column | None = None) -> Column:
    """Date that a horizon (a column of :func:`horizon_text`) points to, from ``start``; null if unclear, or if a date so named is not after ``start``.

    A text is a row of tokens, and what it means follows from their kinds. Named dates: a day, a month (2026-07, July 2026,
    July: the next one), a quarter or half (Q3 2026, 2026H2), a year, the end of this year; each means its last day.
    Spans: a number or the middle of two, in days (a month has 30), and the usual bands. ``parsed`` is a column of
    :func:`horizon_tokens`: given as one of its own, it is computed once a row.
    """
    parsed = horizon_tokens(t) if parsed is None else parsed
    tokens, full, named, shape = parsed["tokens"], parsed["full"], parsed["named"], parsed["shape"]
    word = lambda i: F.try_element_at(named, F.lit(i))
    number = lambda i: word(i).try_cast("int")
    month_no = lambda name: F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name), F.lit(0)).cast("int")
    last = lambda y, m: F.last_day(F.when(m.between(1, 12), F.make_date(y, m, F.lit(1))))
    day = F.concat_ws("-", word(1), F.lpad(word(2), 2, "0"), F.lpad(word(3), 2, "0")).try_cast("date")
    bare = last(F.year(start), month_no(word(1)))
    date = (
        F.when(shape == "Ynn", day).when(shape == "Yn", last(number(1), number(2))).when(shape == "MY", last(number(2), month_no(word(1))))
        .when((shape == "cnY") & (word(1) == "q"), last(number(3), number(2) * 3)).when((shape == "Ycn") & (word(2) == "q"), last(number(1), number(3) * 3))
        .when(shape == "hnY", last(number(3), number(2) * 6)).when(shape == "Yhn", last(number(1), number(3) * 6))
        .when(shape.isin("Y", "Ye", "YUe"), last(number(1), F.lit(12))).when(shape.isin("eY", "rY"), last(number(2), F.lit(12)))
        .when(shape.isin("Ue", "eU") & t.contains("year"), last(F.year(start), F.lit(12)))
        .when(shape == "M", F.when(bare > start, bare).otherwise(last(F.year(start) + 1, month_no(word(1)))))
    )
    days_of = lambda unit: F.coalesce(*[F.when(F.regexp_replace(unit, "s$", "") == k, n) for k, n in UNIT_DAYS.items()])
    code_of = F.coalesce(*[F.when(word(2) == k, n) for k, n in CODE_DAYS.items()])
    at = lambda p, i: F.try_element_at(tokens, F.nullif(F.instr(full, p), F.lit(0)) + i)
    days = F.coalesce(
        (at("n-nU", 0).try_cast("int") + at("n-nU", 2).try_cast("int")) / 2.0 * days_of(at("n-nU", 3)), at("nU", 0).try_cast("int") * days_of(at("nU", 1)),
        F.when(full == "nc", number(1) * code_of), *[F.when(t.rlike(f"^{p}$"), n) for p, n in BANDS],
    )
    unclear = t.isNull() | t.rlike("^(unknown|not specified|n/a|none)?$")
    fixed = F.when(parsed["quiet"], date)
    return F.when(~unclear & fixed.isNotNull(), F.when(fixed > start, fixed)).when(~unclear, F.date_add(start, half_up(days).cast("int")))


def local_to_utc(text: Column, zone: str) -> Column:
    """UTC time of a wall-clock time; null where the clock skips it (the round trip does not give it back)."""
    wall = text.try_cast("timestamp_ntz").cast("timestamp")
    utc = F.to_utc_timestamp(wall, zone)
    return F.when(F.from_utc_timestamp(utc, zone) == wall, utc)


def backoff_minutes(attempt: Column, base: int = 5, most: int = 1440) -> Column:
    """Minutes to wait after the n-th failure: doubling, capped."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1)).cast("long")


def clamp_confidence(said: Column) -> Column:
    """A confidence within 0 and 1; one that was not said, or is no number, is 1."""
    return F.when(said.isNull() | F.isnan(said), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), said)))


def clean_text(raw: Column, most: int) -> Column:
    """Text without blanks at its ends, cut to ``most`` characters; null if nothing is left."""
    return F.left(F.nullif(F.trim(raw), F.lit("")), F.lit(most))


def clamped_number(raw: Column, low: int, high: int) -> Column:
    """A text's number, rounded and kept within bounds; null if it is none or not finite."""
    x = raw.try_cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.when(finite, F.least(F.lit(high), F.greatest(F.lit(low), half_up(x))))


def level_from_forecast(kind: Column, forecast: Column, previous: Column, scale: Column, most: float = 0.25) -> Column:
    """A forecast as a level: as it is, as a change from or a multiple of a unit of the previous level, or as a percentage of it.

    Changes and multiples that end further than ``most`` of the previous level away from it are null (a unit error).
    """
    value = F.when(kind == "delta", previous + forecast * scale).when(kind == "scaled", forecast * scale).when(kind == "relative", previous * (1 + forecast / 100))
    far = (kind != "relative") & (F.abs(value - previous) > F.abs(previous) * most)
    return F.when(kind == "level", forecast).when(~far, value)


def period_fits(period: Column, frequency: Column) -> Column:
    """Whether a period's first day is one that its frequency allows."""
    first = F.day(period) == 1
    return (
        F.when(frequency.isin("DAILY", "WEEKLY", "EVENT"), F.lit(True)).when(frequency == "MONTHLY", first)
        .when(frequency == "QUARTERLY", first & ((F.month(period) - 1) % 3 == 0)).when(frequency == "ANNUAL", first & (F.month(period) == 1)).otherwise(False)
    )
