"""Ranked search over fields of several weights, against the ladder worked out by hand and by brute force."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.operators.search import normal_form, ranked_search, text_scores

SEEN = "item string, weight double, text string, boost double, recency string, group string"


def fields(spark, items):
    """(item, kind, name, alias, secondary, content, day, article) as weighted fields."""
    rows = []
    for item, kind, name, alias, second, content, day, article in items:
        for w, t in ((4.0, name), (3.4, alias), (2.0, second), (0.75, content), (1.35, f"{name} {alias} {second}")):
            rows.append((item, w, t, 1.2 if kind in ("asset", "institution") else 1.0, day, article if kind == "view" else None))
    df = spark.createDataFrame(rows, SEEN)
    return df.withColumn("text", normal_form(F.col("text"))).where("text <> ''")


ITEMS = [
    ("gs", "institution", "Goldman Sachs", "gs", "", "", "", None), ("gold", "asset", "Gold", "xauusd 黄金", "commodity", "", "", None), ("oil", "asset", "Crude Oil (WTI)", "原油", "", "", "", None),
    *[(f"v{k}", "view", f"Gold to rise {k}", "", "Goldman Sachs", "inflation keeps bullion in demand", f"2026-01-0{k}", "a1") for k in range(1, 5)], ("w1", "view", "Gold demand", "", "Citi", "jewellery weak", "2026-01-09", "a2"), ("n", "view", "", "", "", "", "", "a3"),
]


def found(spark, query, **more):
    rows = ranked_search(fields(spark, ITEMS), [query], per_group=2, **more).collect()
    return [r.item for r in sorted(rows, key=lambda r: -r.score)], {r.item: r.score for r in rows}


def test_search_cases(spark):
    names, score = found(spark, "gldman")
    assert names[0] == "gs" and score["gs"] == pytest.approx(24 * 4 * 1.2)  # one letter is missing
    names, score = found(spark, "gold")
    assert score["gold"] == pytest.approx(160 * 4 * 1.2) and names[0] == "gold" and {"w1", "v4", "v3"} <= set(names) and not {"v1", "v2"} & set(names)  # two views of an article, the newest
    assert found(spark, "黄金")[0] == ["gold"] and found(spark, "原油")[0] == ["oil"]
    assert set(found(spark, "gold goldman")[0]) >= {"v3", "v4"}  # the words lie in two fields
    assert found(spark, "bullion")[1]["v4"] == pytest.approx(105 * 0.75)  # said in the text only
    assert found(spark, "zzzz")[0] == [] and found(spark, "gold", top=1)[0] == ["gold"]


def ladder(text, query):
    """The score by its definition."""
    q, tight, compact = query, query.replace(" ", ""), text.replace(" ", "")
    for hit, s in ((text == q, 160), (text.startswith(q), 125), (q in text, 105), (tight in compact, 95)):
        if hit:
            return float(s)

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
        return row[-1]

    def word(w, t):
        if w == t:
            return 48
        if w.startswith(t) or len(w) >= 3 and t.startswith(w):
            return 40
        if t in w:
            return 32
        most = 1 if len(t) <= 5 else 2
        d = far(w, t)
        return 30 - 6 * d if len(t) >= 3 and len(w) >= 3 and abs(len(w) - len(t)) <= most and d <= most else 0

    best = [max(word(w, t) for w in text.split(" ")) for t in q.split(" ")]
    if all(best):
        return sum(best) / len(best)
    grams = lambda s: Counter(s[i : i + 2] for i in range(len(s) - 1))
    a, b = grams(compact), grams(tight)
    dice = 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())) if len(compact) >= 2 and len(tight) >= 4 else 0
    return dice * 36 if dice >= 0.45 else 0.0


@given(st.lists(st.text("abc ", min_size=1, max_size=12).map(lambda t: " ".join(t.split())).filter(bool), min_size=1, max_size=40, unique=True), st.lists(st.text("abc ", min_size=2, max_size=9).map(lambda t: " ".join(t.split())).filter(bool), min_size=1, max_size=3, unique=True))
@settings(max_examples=6, deadline=None)
def test_scores_equal_the_ladder(spark, texts, queries):
    got = {(r.text, r.asked): r.score for r in text_scores(spark.createDataFrame([(t,) for t in texts], "text string"), queries).collect()}
    want = {(t, n): s for t in texts for n, q in enumerate(queries) if (s := ladder(t, q))}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
