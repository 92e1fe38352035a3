"""Grounding of names, figures, certainty and targets, on free text and against naive matching."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestream.operators import grounding as G

ASSETS = {"SOX": ["semiconductor", "chips"], "BTC": ["bitcoin", "btc"], "XAUUSD": ["gold", "黄金"], "WTI": ["oil", "crude"]}
LEAD = "Growth should improve to 2.7% in 2027 as household demand recovers."
#: (source, fields, issues)
ANALYSES = [
    ("The board lifted its growth forecast to 2.7 per cent for 2026, with inflation at 1.9%.", {"summary": "Growth is now seen at 2.7% and inflation at 1.9%.", "numbers": "GDP 2.7% CPI 1.90%"}, []),
    ("The board lifted its growth forecast to 2.7 per cent.", {"summary": "Growth of 2.7%, unemployment of 8.4%."}, [("number_unsupported", "summary", "8.4%")]),
    ("It delivered 25 basis points of tightening; the rate stands at 3%.", {"summary": "A 25bps hike to 3.00%."}, []),
    ("Shares have fallen 1.9% since 25 August 2026.", {"numbers": "-1.9% on 2026-08-25 and 25/08/2026"}, []),
    ("Capex reaches $1,900bn.", {"summary": "Capex of 1900bn in 2 steps.", "summary_zh": "资本开支19000亿美元"}, []),
    ("European growth holds up.", {"summary": "The Bank of Japan may tighten.", "summary_zh": "美联储可能加息"}, [("entity_unsupported", "summary", "Bank of Japan"), ("entity_unsupported", "summary_zh", "Federal Reserve")]),
    ("Costs fed through to prices.", {"summary": "The Fed is done."}, [("entity_unsupported", "summary", "Federal Reserve")]),
    ("Mr Powell spoke.", {"summary": "The Fed is done, says the FOMC."}, []), ("Costs rose.", {"summary": "It fed on itself; the ecbx index rose."}, []),
    ("Rates may fall.", {"summary": "Rates WILL  certainly fall, without a doubt."}, [("certainty_upgrade", "summary", "WILL certainly"), ("certainty_upgrade", "summary", "without a doubt")]),
    ("Rates will surely fall.", {"summary": "Rates will definitely fall."}, []),
    ("European power demand grows through 2050.", {"summary": "We like BTC."}, [("entity_unsupported", "assets", "BTC")]),
    ("The Semiconductor Index fell.", {"summary": "SOX weakened. btc is lower-case here."}, []),
    (LEAD + " Risks remain.", {"summary": LEAD}, [("summary_copies_source_lead", "summary", LEAD.rstrip(".").lower())]),
    ("Growth improves.", {"risks": "This does not constitute an offer."}, [("boilerplate_in_analysis", "risks", "This does not constitute an offer.")]),
    ("Growth improves by 2027.", {"summary": "Growth improves by 2027 or 2031."}, [("forecast_year_unsupported", "summary", "2031")]),
    (None, {"summary": "A 25bps hike."}, [("number_unsupported", "summary", "25bps")]), ("Text.", {"summary": None, "risks": "  "}, []),
]


@pytest.fixture(scope="module")
def judged(spark):
    fields = ["summary", "numbers", "risks", "summary_zh"]
    rows = [(k, s, *[f.get(c) for c in fields]) for k, (s, f, _) in enumerate(ANALYSES)]
    df = spark.createDataFrame(rows, "k int, source string, " + ", ".join(f"{c} string" for c in fields))
    return {r.k: r for r in G.analysis_issues(df, "k", "source", fields, ASSETS).collect()}


@pytest.mark.parametrize("k", range(len(ANALYSES)))
def test_analyses(judged, k):
    want = ANALYSES[k][2]
    assert sorted(map(tuple, judged[k].issues)) == sorted(want)
    assert judged[k].score == round(max(0, 1 - 0.12 * len(want)), 2)


@pytest.mark.parametrize(("text", "want"), [
    ("2.70 and 1,250.00", [("2.70", "2.7"), ("1250.00", "1250")]), ("5 or 05", [("05", "5")]), ("in 2026 at 2026%", [("2026%", "2026")]), ("01.02.2024 7/8/24 2024/1/2", []),
    ("5 percentage points, 7 pct, 30 bp", [("5%", "5"), ("7%", "7"), ("30bps", "30")]), ("１２％", [("12%", "12")]), ("", []),
])
def test_figures(text, want):
    assert G.figures(G.plain(text)) == want


def test_matcher_equals_naive_search():
    rng = random.Random(4)
    words = ["fed", "fed up", "up", "a", "öl", "oil", "oil_x", "x", "市", "市场", "U.S."]
    terms = [(w.upper(), w, w == "up") for w in words]
    matcher = G.Matcher(terms)
    for _ in range(400):
        text = "".join(rng.choice(["fed", " ", "Fed", "up", "UP", "a", "öl", "oil", "_", "x", "市", "场", ".", "U.S.", "é"]) for _ in range(12))
        want = set()
        for name, term, exact in terms:
            edge = lambda c: r"(?<![A-Za-z0-9_])" if re.match("[A-Za-z0-9_]", c) else ""
            tail = r"(?![A-Za-z0-9_])" if re.match("[A-Za-z0-9_]", term[-1]) else ""
            for m in re.finditer(f"(?=({edge(term[0])}{re.escape(term)}{tail}))", text, 0 if exact else re.I | re.A):
                want.add((name, m.start(1), m.end(1)))
        assert set(matcher.find(text)) == want


def test_mentions_in_parts(spark, monkeypatch):
    df = spark.createDataFrame([(1, "gold and Oil, oil"), (2, None), (3, "silver")], "id long, t string")
    terms = [("metal", "gold", False), ("energy", "oil", False), ("metal", "silver", False)]
    whole = sorted(map(tuple, G.mentions(df, ["id"], "t", terms).collect()))
    assert whole == [(1, "energy", 2, 9), (1, "metal", 1, 0), (3, "metal", 1, 0)]
    monkeypatch.setattr(G._parts, "__defaults__", (80,))
    assert len(list(G._parts(terms))) > 1 and sorted(map(tuple, G.mentions(df, ["id"], "t", terms).collect())) == whole
    assert G.mentions(df, ["id"], "t", []).count() == 0


YE = "year-end 2027"
#: (source, target, previous, horizon, kept (target, previous, horizon), codes)
CLAIMS = [
    ("The bank raised its year-end 2027 gold price target from $4,800 to $5,000 as demand stayed firm.", 5000.0, 4800.0, YE, (5000.0, 4800.0, YE), []),
    ("The bank raised its gold price target to $5,000.", 5000.0, None, None, (None, None, None), ["forecast_horizon_missing"]),
    ("The bank raised its gold price target to $5,000.", 5000.0, None, "  ", (None, None, None), ["forecast_horizon_missing"]),
    ("The bank raised its gold price target to $5,000.", 5000.0, None, YE, (None, None, None), ["forecast_horizon_unsupported"]),
    ("The year-end 2027 gold outlook remains constructive.", 5000.0, None, YE, (None, None, YE), ["forecast_target_unsupported"]),
    ("The bank set a year-end 2027 gold target of 5,000.", 5000.0, None, YE, (None, None, YE), ["forecast_unit_missing"]),
    ("The bank set a year-end 2027 target of €5,000.", 5000.0, None, YE, (None, None, YE), ["forecast_unit_unsupported"]),
    ("At 5000 US dollars, the 12-month TARGET is unchanged.", 5000.0, None, "12m", (5000.0, None, "12m"), []),
    ("We forecast 71.25 dollars per barrel in six months.", 71.25, None, "six months", (71.25, None, "six months"), []),
    ("Target kept. Shares trade at $90 for 2027.", 90.0, None, "2027", (None, None, "2027"), ["forecast_target_unsupported"]),
    ("Target, " + "x" * 120 + " $90 for 2027.", 90.0, None, "2027", (None, None, "2027"), ["forecast_target_unsupported"]),
    ("The forecast of $80 falls short. A target of $90 for 2027.", 90.0, 80.0, "2027", (90.0, 80.0, "2027"), []),
    ("Nothing.", None, None, "unspecified", (None, None, None), ["forecast_horizon_unsupported"]), ("Nothing.", None, None, None, (None, None, None), []),
    (None, 1.0, None, "2027", (None, None, None), ["forecast_horizon_unsupported"]),
]


def test_claims(spark):
    df = spark.createDataFrame([(k, s, "T", t, p, h) for k, (s, t, p, h, _, _) in enumerate(CLAIMS)], "k int, source string, ticker string, target double, previous_target double, horizon string")
    got = {r.k: r for r in G.supported_claims(df).collect()}
    for k, (source, *_, kept, codes) in enumerate(CLAIMS):
        assert ((got[k].target, got[k].previous_target, got[k].horizon), [i.code for i in got[k].issues]) == (kept, codes), source


@pytest.mark.parametrize(("value", "want"), [(5000.0, "(5000|5,000)"), (71.25, r"(71\.25|71\.25)"), (1234567.5, r"(1234567\.5|1,234,567\.5)"), (12.0, "(12|12)")])
def test_number_forms(spark, value, want):
    assert spark.createDataFrame([(value,)], "v double").select(G.number_forms(F.col("v"))).first()[0] == want
