"""Monitoring rules of each kind over small states."""

import datetime as dt

from pyspark.sql import functions as F

from lodestream.operators import alerts as A

RULES = "rule_id long, kind string, scope string, ref string, threshold double"


def rules(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], RULES)


def hits(df):
    return {r.rule_id: (r.target, r.score, r.message) for r in df.collect()}


def test_consensus(spark):
    state = spark.createDataFrame([("gold", 70, -5), ("oil", 30, None), ("btc", 50, 8)], "asset string, score long, change long")
    r = rules(spark, *[(k, "asset", a, t) for k, a, t in (("CONSENSUS_ABOVE", "gold", 70.0), ("CONSENSUS_ABOVE", "gold", 71.0), ("CONSENSUS_BELOW", "oil", 30.0), ("CONSENSUS_DROP_24H", "gold", 5.0), ("CONSENSUS_DROP_24H", "gold", 6.0), ("CONSENSUS_RISE_24H", "btc", 8.0), ("CONSENSUS_DROP_24H", "oil", 1.0), ("CONSENSUS_ABOVE", "none", 0.0), ("OTHER", "gold", 0.0), ("CONSENSUS_ABOVE", None, 0.0))])
    assert hits(A.consensus_hits(r, state)) == {0: ("gold", 70.0, "gold consensus 70 (24h -5)"), 2: ("oil", 30.0, "oil consensus 30"), 3: ("gold", 70.0, "gold consensus 70 (24h -5)"), 5: ("btc", 50.0, "btc consensus 50 (24h +8)")}


def test_releases(spark):
    day = dt.datetime(2026, 9, 1)
    rows = [("r1", "CPI", "cpi", "CPI", day, 0.5, True), ("r2", "CPI", "cpi", "CPI", day + dt.timedelta(9), 0.05, True), ("r2", "CPI", "core", "CPI", day + dt.timedelta(9), -0.2, False), ("r3", "CPI", "cpi", "CPI", None, 9.0, True), ("r4", "GDP", "gdp", "GDP", day, None, True)]
    state = spark.createDataFrame(rows, "release_id string, family string, indicator string, title string, released_at timestamp, surprise_pct double, licensed boolean")
    fam, ind = "macro_release_family", "macro_indicator"
    r = rules(spark, ("MACRO_RELEASE", fam, "CPI", None), ("MACRO_RELEASE", ind, "cpi", None), ("MACRO_SURPRISE_ABOVE", ind, "cpi", 5.0), ("MACRO_SURPRISE_ABOVE", ind, "cpi", 5.1), ("MACRO_SURPRISE_BELOW", ind, "core", -10.0), ("MACRO_SURPRISE_BELOW", fam, "CPI", 6.0), ("MACRO_SURPRISE_ABOVE", ind, "gdp", 0.0), ("MACRO_RELEASE", fam, "none", None))
    said = {k: m for k, (_, _, m) in hits(A.release_hits(r, state)).items()}
    assert said == {0: "CPI released", 1: "CPI released", 2: "cpi surprise 5.0%", 5: "cpi surprise 5.0%"}
    assert {t for t, _, _ in hits(A.release_hits(r, state)).values()} == {"r2"}


def test_revisions(spark):
    state = spark.createDataFrame([("cpi", "a", 1, 0, 3.0), ("cpi", "b", 2, 1, 3.1), ("cpi", "c", 3, 2, 3.2), ("gdp", "d", 1, 0, 1.0)], "indicator string, observation_id string, vintage int, revision_no int, value double")
    r = rules(spark, ("MACRO_REVISION", "macro_indicator", "cpi", None), ("MACRO_REVISION", "macro_indicator", "gdp", None), ("MACRO_REVISION", "asset", "cpi", None))
    assert hits(A.revision_hits(r, state)) == {0: ("c", None, "cpi revised to 3.2")}


def test_policies(spark):
    rows = [("FED", f"f{k}", k, d, s, b) for k, (d, s, b) in enumerate([("HIKE", "HAWKISH", 25.0), ("CUT", "DOVISH", -25.0), ("OTHER", "UNKNOWN", None)])] + [("ECB", "e1", 1, "HOLD", "NEUTRAL", 0.0), ("ECB", "e2", 2, "OTHER", "NEUTRAL", None), ("BOJ", "b", 1, "OTHER", None, None)]
    state = spark.createDataFrame(rows, "bank string, document_id string, published_at int, decision string, stance string, change_bps double")
    r = rules(spark, *[(k, "central_bank", b, None) for k in A.POLICY for b in ("FED", "ECB", "BOJ")])
    assert {k: (t, m) for k, (t, _, m) in hits(A.policy_hits(r, state)).items()} == {0: ("f1", "FED decision: CUT (-25 bp)"), 1: ("e1", "ECB decision: HOLD (0 bp)"), 3: ("f1", "FED stance: HAWKISH -> DOVISH")}
    assert hits(A.policy_hits(r, state, newest=1)) == {}


def test_research(spark):
    at = lambda h: dt.datetime(2026, 9, 2, h)
    state = spark.createDataFrame([(1, "gold", "gs", "Old", at(1)), (2, "gold", "gs", "New", at(9)), (2, "oil", "gs", "New", at(9)), (3, "oil", "citi", "Later", at(20)), (4, None, "citi", "Mid", at(8))], "article_id long, asset string, institution string, title string, published_at timestamp")
    r = rules(spark, ("RESEARCH", "asset", "gold", None), ("RESEARCH", "asset", "oil", None), ("RESEARCH", "institution", "citi", None), ("RESEARCH", "asset", "btc", None))
    got = hits(A.research_hits(r, state, F.lit(at(2)), F.lit(at(12))))
    assert got == {0: ("2", None, "gs: New"), 1: ("2", None, "gs: New"), 2: ("4", None, "citi: Mid")}
