"""Operators and helpers on small cases with known answers."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodestream.functions.scalar import change, decimal_string, decimal_text, half_up, horizon_end, horizon_text, horizon_tokens, local_to_utc, period_start, rate, strict_sum, wilson
from lodestream.plans.capture import is_fresh
from lodestream.plans.texts import policies, stated_target
from lodestream.operators.relational import asof_backward, asof_within, changed_only, keyset_page, latest_per_key, ranked_values, sessions
from lodestream.operators.text import bigram_dice, canonical_url, robots_verdict, sentences


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize("x,want", [(2.5, 3), (-2.5, -2), (0.49, 0), (-0.5, 0)])
def test_half_up(spark, x, want):
    assert one(spark, half_up(F.col("x")), x=x) == want


def test_rates(spark):
    assert one(spark, rate(F.col("a"), F.col("b")), a=1.0, b=0.0) is None
    assert one(spark, rate(F.col("a"), F.col("b")), a=1.0, b=3.0) == 33.3
    assert one(spark, change(F.col("a"), F.col("b")), a=5.0, b=0.0) is None


def test_strict_sum(spark):
    df = spark.createDataFrame([(1, 2), (1, None), (2, 3)], "k int, x int")
    assert {r.k: r.s for r in df.groupBy("k").agg(strict_sum(F.col("x")).alias("s")).collect()} == {1: None, 2: 3}


def test_wilson(spark):
    low, high = wilson(F.col("a"), F.col("b"))
    assert one(spark, low, a=8.0, b=10.0) < 0.8 < one(spark, high, a=8.0, b=10.0)
    assert one(spark, low, a=0.0, b=0.0) is None


@pytest.mark.parametrize("text,want", [("1,234.5", 1234.5), ("(2.5)", -2.5), ("−3", -3.0), (".", None), ("-", None), ("N/A", None), ("1e-3", 0.001), ("..", None), ("None", None), ("na", None), ("0.1", 0.1), ("abc", None), (None, None)])
def test_decimal_text(spark, text, want):
    got = one(spark, decimal_text(F.col("x")), x=text)
    assert (got is None) == (want is None) and (got is None or got == Decimal(str(want)))


@pytest.mark.parametrize("text,want", [
    ("12,345,678,901,234,567,890.1234500", "12345678901234567890.12345"), ("12345678901234567890.123456789012345", "12345678901234567890.123456789012345"), ("1e-30", "0." + "0" * 29 + "1"), ("0.000000000000000000000000000001", "0." + "0" * 29 + "1"), ("314.100", "314.1"),
    ("-0.0", "0"), ("+1.5E3", "1500"), ("12.5e-1", "1.25"), ("(2.50)", "-2.5"), (".5", "0.5"), ("5.", "5"), ("007", "7"), (".", None), ("1e9999", None), ("e5", None), ("1.2.3", None), ("---", None), (None, None),
])
def test_decimal_string(spark, text, want):
    assert one(spark, decimal_string(F.col("x")), x=text) == want


@pytest.mark.parametrize("text", ["1e-30", "12345678901234567890.123456789012345", "1e30"])
def test_decimals_beyond_the_type_are_null(spark, text):
    assert one(spark, decimal_text(F.col("x")), x=text) is None


@pytest.mark.parametrize("text,frequency,want", [("2026-M05", "MONTHLY", dt.date(2026, 5, 1)), ("2026-m05", None, dt.date(2026, 5, 1)), ("2026-05", "QUARTERLY", None), ("2026", "MONTHLY", None), ("2026", "ANNUAL", dt.date(2026, 1, 1)), ("2026q3", "QUARTERLY", dt.date(2026, 7, 1)), ("2026-Q3", "ANNUAL", None), ("2026-05-09", "WEEKLY", dt.date(2026, 5, 9)), ("2026-13", "MONTHLY", None), ("2026-5", "MONTHLY", None)])
def test_period_of_a_frequency(spark, text, frequency, want):
    assert one(spark, period_start(F.col("x"), F.lit(frequency) if frequency else None), x=text) == want


@pytest.mark.parametrize("text,want", [("2026-Q3", dt.date(2026, 7, 1)), ("2026", dt.date(2026, 1, 1)), ("2026-05", dt.date(2026, 5, 1)), ("2026-05-09", dt.date(2026, 5, 9)), ("2026-13", None), ("May", None)])
def test_period_start(spark, text, want):
    assert one(spark, period_start(F.col("x")), x=text) == want


HORIZONS = [("3M", dt.date(2026, 4, 1)), ("2 weeks", dt.date(2026, 1, 15)), ("end of 2027", dt.date(2027, 12, 31)), ("2026-Q2", dt.date(2026, 6, 30)), ("Year-end", dt.date(2026, 12, 31)), ("soon", None), ("2-4 months (base case)", dt.date(2026, 4, 1)), ("q1 2027", dt.date(2027, 3, 31)), ("2025", None), ("March", dt.date(2026, 3, 31)), ("2026/2/3", dt.date(2026, 2, 3)), ("mid-term", dt.date(2026, 4, 1)), (None, None), ("over time", None), ("H1 2028", dt.date(2028, 6, 30)), ("12 months", dt.date(2026, 12, 27)), ("1 year", dt.date(2027, 1, 1)), ("next 8–10 weeks", dt.date(2026, 3, 5)), ("3 to 6 months", dt.date(2026, 5, 16)), ("medium-term (3-6 months)", dt.date(2026, 4, 1)), ("2026年12月", dt.date(2026, 12, 31)), ("2026 year-end", dt.date(2026, 12, 31)), ("July 2026", dt.date(2026, 7, 31)), ("2026H2", dt.date(2026, 12, 31)), ("end of the year", dt.date(2026, 12, 31)), ("rest of 2026", dt.date(2026, 12, 31)), ("January", dt.date(2026, 1, 31)), ("coming quarters", None), ("next months", None), ("over 2026 or so", None), ("2026-02-30", None), ("2025-01-31", None)]


def test_horizon_end(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(HORIZONS)], "k int, x string").withColumn("h", horizon_text(F.col("x"))).withColumn("p", horizon_tokens(F.col("h")))
    got = {r.k: r.due for r in df.select("k", horizon_end(F.lit("2026-01-01").cast("date"), F.col("h"), F.col("p")).alias("due")).collect()}
    assert {HORIZONS[k][0]: v for k, v in got.items()} == dict(HORIZONS)


def test_local_to_utc(spark):
    got = lambda t: one(spark, F.date_format(local_to_utc(F.col("x"), "America/New_York"), "HH:mm"), x=t)
    assert got("2026-01-05T08:30:00") == "13:30"
    assert got("2026-07-06T08:30:00") == "12:30"
    assert got("2026-03-08T02:30:00") is None


def test_latest_and_changes(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 6), ("b", 1, None), ("b", 2, None)], "k string, t int, v int")
    assert {(r.k, r.t, r.v) for r in latest_per_key(df, ["k"], ["t"]).collect()} == {("a", 3, 6), ("b", 2, None)}
    assert {(r.k, r.t) for r in changed_only(df, ["k"], "t", "v").collect()} == {("a", 1), ("a", 3), ("b", 1)}


def test_asof(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, 20, 1), ("a", 5, 50, 2), ("a", 5, 51, 3)], "k string, t int, v int, tie int")
    got = {r.id: r.hit for r in asof_backward(left, right, ["k"], "t", "t", "v", "tie", "hit").collect()}
    assert got == {1: 51, 2: None, 3: None}


def test_asof_within(spark):
    day = lambda df: df.withColumn("d", F.col("d").cast("date"))
    left = day(spark.createDataFrame([(1, "a", "2026-01-10"), (2, "a", "2026-02-01")], "id int, k string, d string"))
    right = day(spark.createDataFrame([("a", "2026-01-09", 1.0), ("a", "2026-01-17", 2.0), ("a", "2026-01-12", 3.0)], "k string, d string, v double"))
    assert {r.id: r.x for r in asof_within(left, right, ["k"], "d", "d", 7, True, "v", "x").collect()} == {1: 3.0, 2: None}
    assert {r.id: r.x for r in asof_within(left, right, ["k"], "d", "d", 7, False, "v", "x").collect()} == {1: 1.0, 2: None}


def test_ranked_values(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, 4.0, 4.0)] + [("b", 7.0), ("b", None)], "k string, v double")
    picks = {"p75": F.least(F.col("n") - 1, F.floor(F.col("n") * 0.75)), "upper": F.floor(F.col("n") / 2)}
    assert {r.k: (r.n, r.p75, r.upper) for r in ranked_values(df, ["k"], "v", picks).collect()} == {"a": (5, 4.0, 3.0), "b": (1, 7.0, 7.0)}


def test_sessions_and_pages(spark):
    rows = [(1, f"2024-01-01 00:{m:02d}:00") for m in (0, 10, 39)] + [(1, "2024-01-01 01:09:00")]
    df = spark.createDataFrame(rows, "u int, ts string").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("id", F.monotonically_increasing_id())
    assert sorted(r.session_no for r in sessions(df, "u", "ts", "id").collect()) == [1, 1, 1, 2]
    page = keyset_page(spark.range(10), ["id"], [7], 3).orderBy(F.desc("id")).collect()
    assert [(r.id, r.has_more) for r in page] == [(6, True), (5, True), (4, True)]


def test_text(spark):
    assert one(spark, canonical_url(F.col("x")), x="http://www.A.com/b/amp/?utm_source=1&z=2&a=1#t") == "https://a.com/b?a=1&z=2"
    assert one(spark, F.size(sentences(F.col("x"))), x="Mr. Smith left. He came back! Why?") == 3
    assert one(spark, bigram_dice(F.col("a"), F.col("b")), a="night", b="nacht") == 0.25
    rules = [("disallow", "/a"), ("allow", "/a/b"), ("disallow", "/*.pdf$")]
    got = [one(spark, robots_verdict(F.col("x"), rules), x=p) for p in ("/a/x", "/a/b/c", "/c/d.pdf", "/c")]
    assert got == [False, True, False, True]


FRESH = "period date, target date, vintage date, scheduled date, status string, published date, before int, before_at date, value int"
JUL, JUN, DAY = dt.date(2026, 7, 1), dt.date(2026, 6, 1), dt.date(2026, 8, 12)


@pytest.mark.parametrize("change,want", [
    ({}, True), ({"period": JUN}, False), ({"vintage": DAY - dt.timedelta(1)}, False), ({"status": "DRAFT"}, False), ({"published": DAY}, True), ({"published": DAY - dt.timedelta(1)}, False),
    ({"before": 5}, False), ({"before": 6}, True), ({"before": 5, "before_at": DAY}, True),
])
def test_fresh_prints_are_of_the_target_period(spark, change, want):
    row = {"period": JUL, "target": JUL, "vintage": DAY, "scheduled": DAY, "status": "PUBLISHED", "published": None, "before": None, "before_at": JUN if change.get("before") else None, "value": 5} | change
    df = spark.createDataFrame([tuple(row.values())], FRESH)
    assert df.select(F.coalesce(is_fresh(), F.lit(False))).first()[0] is want


@pytest.mark.parametrize("text,want", [
    ("Target price from $10 to $12.", (12.0, 10.0)), ("target price cut FROM 1,500.50 → 1,250 today", (1250.0, 1500.5)), ("Forecast moved from $90 -> $95; price objective $99.", (95.0, 90.0)), ("Our price objective is now $ 4,800 and the forecast $5,000.25.", (5000.25, None)),
    ("Shares cost $90. The target is unchanged.", (None, None)), ("The target is unchanged. Shares cost $90.", (None, None)), ("Target of $5.", (None, None)), ("A forecast of 90 dollars.", (None, None)), ("Target " + "x" * 70 + " $90", (None, None)),
    ("TARGET $90, later $95", (90.0, None)), ("target from strength to $90", (90.0, None)), ("", (None, None)), (None, (None, None)),
])
def test_stated_targets(spark, text, want):
    target, previous = stated_target(F.col("x"))
    r = spark.createDataFrame([(text,)], "x string").select(target.alias("t"), previous.alias("p")).first()
    assert (r.t, r.p) == want


STATEMENTS = [
    ("The Committee decided to maintain the target range for the federal funds rate at 4-1/4 to 4-1/2 percent.\n\nVoting for the monetary policy action were Jerome H. Powell, John C. Williams, and Philip N. Jefferson.", ("HOLD", 0.0, 4.25, 4.5, 3, 0)),
    ("The board approved the following by a 9 – 3 vote:\n\nThe Committee decided to maintain the target range for the federal funds rate at 3-1/2 to 3-3/4 percent.\n\nVoting against the action were Beth M. Hammack, Neel Kashkari, and Lorie K. Logan, who preferred to raise the target range for the federal funds rate by 1/4 percentage point.", ("HOLD", 0.0, 3.5, 3.75, 9, 3)),
    ("Today it lowered the target range for the federal funds rate by 1/2 percentage point, to 4¾ to 5 percent. Voting for this action were Ann B. Lee and Bo Li. Voting against this action was Cy D. Ray, who preferred less.", ("CUT", -50.0, 4.75, 5.0, 2, 1)),
    ("The Committee raised its outlook and agreed to increase the target range by 75 basis points, to 1.5 to 1.75 percent.", ("HIKE", 75.0, 1.5, 1.75, None, None)),
    ("Growth was solid.", ("OTHER", None, None, None, None, None)),
]


def test_policy_statements(spark):
    got = {r.day: tuple(r)[1:] for r in policies(spark.createDataFrame([(k, s) for k, (s, _) in enumerate(STATEMENTS)], "day int, body string")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(STATEMENTS)}
