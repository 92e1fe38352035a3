"""Schedules of two publishers, spans, and Latin spellings of Chinese names."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.operators import pinyin as P
from lodestream.sources import schedules as S

FAMILIES = [("GDP", ["gross domestic product", "gdp ("], "08:30"), ("TRADE", ["international trade in goods"], "08:30"), ("INCOME", ["personal income"], None)]
TABLE = """<script>document.write("<table><tr><td>x</td></tr></table>")</script>
<table class="sched"><tr><th>Date</th><th>Release</th></tr>
<tr><td class="date" rowspan=2><div class="release-date">January 9 </div><small>8:30 AM</small></td><td class="release-title">U.S. International Trade in Goods and&nbsp;Services, November 2026</td>
<tr><td class="release-title">Personal Income, <i>November</i> 2026</td></tr>
<tr><td><div class="release-date">March 28</div></td><td class="release-title">GDP (Third Estimate)</td></tr>
<tr><td><div class="release-date">March 28, 2027</div><small>10:00 am</small></td><td class="release-title">GDP (Corporate)</td></tr>
<tr><td><div class="release-date">May 1</div><small>noon</small></td><td class="release-title">Personal Income, March</td></tr>
<tr><td><div class="release-date">Smarch 1</div></td><td class="release-title">GDP (Odd)</td></tr>
<tr><td><div class="release-date">June 3</div></td><td class="release-title">Fixed Assets</td></tr></table>
<table><thead><tr><th>Release<th>Date<th>Time</thead><tr><td>Gross Domestic Product, 2nd<td>November 1<td>1:30 p.m.</table>"""
WANT = [
    ("TRADE", "TRADE:u-s-international-trade-in-goods-and-services-november-2026", "2027-01-09T08:30:00"), ("INCOME", "INCOME:personal-income-november-2026", "2027-01-09T08:30:00"),
    ("GDP", "GDP:gdp-third-estimate", "2027-03-28T08:30:00"), ("GDP", "GDP:gross-domestic-product-2nd", "2027-11-01T13:30:00"),
]
PANELS = """<div class="panel panel-default"><div class="panel-heading"><h4>2027 FOMC Meetings</h4></div>
<div class="row fomc-meeting"><div class="fomc-meeting__month"><strong>January</strong></div><div class="fomc-meeting__date">26-27</div></div>
<div class="row fomc-meeting"><div class="fomc-meeting__month"><strong>March</strong></div><div class="fomc-meeting__date">16-17*</div><p>Statement</p></div>
<div class="row fomc-meeting"><div class="fomc-meeting__month">Apr/May</div><div class="fomc-meeting__date">30-1</div></div>
<div class="row fomc-meeting"><div class="fomc-meeting__month">April/May</div><div class="fomc-meeting__date">30-1</div></div>
<div class="row fomc-meeting"><div class="fomc-meeting__month">August</div><div class="fomc-meeting__date">tbd</div></div></div>
<div class="panel"><div class="panel-heading">Notes</div><div class="fomc-meeting"><div class="fomc-meeting__month">May</div><div class="fomc-meeting__date">1</div></div></div>
<div class="panel"><div class="panel-heading">2028 FOMC Meetings</div><div class="fomc-meeting"><div class="fomc-meeting__month">January</div><div class="fomc-meeting__date">3</div></div></div>"""


def test_both_shapes():
    assert S.listed_releases(TABLE, 2027, FAMILIES) == WANT
    assert S.panel_meetings(PANELS, "FOMC", "14:00") == [("FOMC", f"FOMC:{y}:{k}", f"{y}-{d}T14:00:00") for y, k, d in ((2027, 1, "01-27"), (2027, 2, "03-17"), (2027, 3, "05-01"), (2027, 4, "05-01"), (2028, 1, "01-03"))]
    for nothing in (None, "", "<table><tr></table>", "</table></td><td>x", "<div class=panel>"):
        assert S.listed_releases(nothing, 2027, FAMILIES) == [] and S.panel_meetings(nothing, "FOMC", "14:00") == []


def test_spans_are_carried_down_and_across():
    table = S._page('<table><tr><th>a<th colspan=2>b<tr><td rowspan=3>1<td>2<td>3<tr><td colspan="2" rowspan="2">4<tr><tr><td>5<td rowspan=99>6<td>7</table>').tables[0]
    assert [[c and c.text for c in row] for row in S.spread(table)] == [["a", "b", "b"], ["1", "2", "3"], ["1", "4", "4"], ["1", "4", "4"], ["5", "6", "7"]]
    inner = S._page("<table><tr><td>x<table><tr><td>y</table><td>z</table>").tables
    assert [[c.text for row in t for c in row] for t in inner] == [["x", "z"], ["y"]]


@pytest.mark.parametrize(("text", "want"), [("8:30 AM", "08:30"), ("12:05 a.m.", "00:05"), ("12:00 pm", "12:00"), ("2:00 p.m. ET", "14:00"), ("13:00 pm", None), ("14:00", None), ("", None)])
def test_clock(text, want):
    assert S.clock(text) == want


def test_schedule_rows(spark):
    df = spark.createDataFrame([(1, TABLE, 2027, "table"), (2, PANELS, None, "panels"), (3, None, 2027, "table"), (4, TABLE.replace("March 28<", "March 14<").replace("GDP (Third", "2:30 GDP (Third"), 2027, "table")], "id long, html string, year int, k string")
    got = S.schedules(df, "id", F.col("k"), "America/New_York", FAMILIES, ("FOMC", "14:00")).collect()
    at = {(r.id, r.release_id): str(r.scheduled_at) for r in got}
    assert at[1, WANT[0][1]] == "2027-01-09 13:30:00" and at[1, WANT[2][1]] == "2027-03-28 12:30:00" and at[2, "FOMC:2027:2"] == "2027-03-17 18:00:00"
    assert {r.id for r in got} == {1, 2, 4} and len(got) == 2 * len(WANT) + 5


# --- spellings ----------------------------------------------------------------------------------

READINGS = {"黄": ["huang"], "金": ["jin"], "美": ["mei"], "联": ["lian"], "储": ["chu"], "重": ["zhong", "chong"], "庆": ["qing"], "银": ["yin"], "行": ["hang", "xing"], "长": ["chang", "zhang"]}


@pytest.mark.parametrize(("query", "name", "want"), [
    ("huangjin", "黄金", 96), ("HUANG JIN", "黄金", 96), ("huang", "黄金", 84), ("huangj", "黄金", 84), ("angjin", "黄金", 62), ("jin", "黄金", 0), ("hj", "黄金", 78), ("h", "黄金", 0), ("ml", "美联储", 58), ("mlc", "美联储", 78), ("mlcf", "美联储FOMC", 78),
    ("meilianchufomc", "美联储FOMC", 96), ("fomc", "美联储FOMC", 62), ("lianchu", "美联储", 62), ("chongqing", "重庆", 96), ("zhongqing", "重庆", 96), ("cq", "重庆", 78), ("zq", "重庆", 78), ("xq", "重庆", 0), ("chongqingyinhang", "重庆银行", 96), ("qingyinx", "重庆银行", 62),
    ("gold", "gold", 0), ("huangjin", "", 0), ("zz", "黄金", 0), ("huangjinx", "黄金", 0), ("ming", "黄明金", 0), ("huangjin", "黄·金", 96),
])
def test_spellings(query, name, want):
    assert P.score(query, name, READINGS) == want


@given(st.text("黄重行长A ", min_size=1, max_size=5), st.text("huangcozxA", min_size=2, max_size=9))
@settings(max_examples=400, deadline=None)
def test_search_equals_all_combinations(name, query):
    q = query.lower()
    rows = P.units(name, READINGS)
    full = {"".join(c) for c in itertools.product(*rows)} if rows else set()
    first = {"".join(c) for c in itertools.product(*[sorted({t[:1] for t in u if t}) for u in rows])} if len(rows) >= 2 else set()
    want = 96 if q in full else 84 if any(f.startswith(q) for f in full) else 62 if len(q) >= 4 and any(q in f for f in full) else 78 if q in first else 58 if any(f.startswith(q) for f in first) else 0
    assert P.score(query, name, READINGS) == want


def test_spellings_of_rows(spark):
    names = spark.createDataFrame([(1, "黄金"), (2, "重庆银行"), (3, None), (4, "gold")], "id long, name string")
    dictionary = spark.createDataFrame([(c, r) for c, rs in READINGS.items() for r in rs] + [("无", "wu")], "character string, reading string")
    assert sorted(map(tuple, P.matches(names, "id", "name", ["hj", "chongqing", "zqyh"], dictionary).collect())) == [(1, "hj", 78), (2, "chongqing", 84), (2, "zqyh", 78)]
