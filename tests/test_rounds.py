"""Queries on small tables made for what a review found, against their SQL."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestream import session
from lodestream.operators.gate import broken_word
from lodestream.plans import registry
from lodestream.sources.versioned import VersionedTable

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture
def equals(spark, tmp_path):
    """A check that a query equals its SQL on tables given as name -> (schema, rows)."""

    def check(name: str, **tables) -> list[tuple]:
        con = duckdb.connect()
        for t, (schema, rows) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        got = sorted((tuple(r) for r in df.collect()), key=str)
        asked = con.execute(SQL[name])
        columns = [c[0] for c in asked.description]
        want = [tuple(r[columns.index(c)] for c in df.columns) for r in asked.fetchall()]
        assert got == sorted(want, key=str)
        return got

    return check


LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"


def line(order, price=100.0, quantity=1.0, number=1, supplier=7, part=1, discount=0.0, tax=0.0, day=1):
    return (order, part, supplier, number, quantity, price, discount, tax, dt.datetime(2024, 1, day))


def test_halves_round_to_even(equals):
    """A price of x.5 may round to a year, or to the quantity at another scale, depending on the rule for halves."""
    prices = [1897.5, 1898.5, 1899.5, 2198.5, 2199.5, 2200.5, 49999.5, 50000.5, 50001.5]
    equals("translation_check", lineitem=(LINES, [line(k * 3 + n, p, 5.0, n) for k, p in enumerate(prices) for n in (1, 2, 3)] + [line(99, 50000.0, q) for q in (4.5, 5.5)]))
    equals("deviation_of_changes", lineitem=(LINES, [line(k, quantity=q, day=k + 1) for k, q in enumerate((1.5, 2.5, 3.5, 0.6))]))


def test_evidence_is_chosen_inside_its_row(spark, tmp_path):
    """The fold skips what does not fit and tries smaller ones; no document is sent to another task or to Python."""
    said = ["Low one here.", "x" * 900 + ".", "y1" * 200 + ".", "z2" * 300 + ".", "Last 7.", "Plain."]
    rows = [(1, " ".join(said)), (2, None), (3, ""), (4, "One.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["evidence_selection"](spark, str(tmp_path))
    left, kept = 1200, []
    score = [2 * (k < 3) + 3 * any(c.isdigit() for c in x) for k, x in enumerate(said)]
    for k in sorted(range(len(said)), key=lambda k: (-score[k], k)):
        if len(said[k]) <= left:
            kept.append((1, k, len(said[k]), score[k]))
            left -= len(said[k])
    assert [k for _, k, _, _ in kept] == [2, 3, 4, 0, 5]
    assert sorted(map(tuple, df.collect())) == sorted([*kept, (4, 0, 4, 2)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "InPandas" not in plan


def test_equal_claims_are_judged_once(spark, equals, tmp_path):
    """Lines of a part share six claims at most; lines without a quantity count as those of ten or more."""
    parts = [(k, f"part {k}", k, 100.0 + k) for k in range(4)]
    lines = [line(k, part=k % 5, number=k % 4 + 1, quantity=q) for k in range(40) for q in (5.0, 10.0, None)]
    got = equals("target_support", part=("p_partkey long, p_name string, p_size int, p_retailprice double", parts), lineitem=(LINES, lines))
    assert sum(n for _, n in got) == 96
    plan = QUERIES["target_support"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate [l_partkey")  # lines are counted before the claims are judged


def test_clustered_table_computes_its_rows_once(spark, tmp_path):
    """Drawing the ranges of a clustered table does not compute the rows a second time."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def slow(k):
        seen.add(1)
        return k * 2

    store = VersionedTable(spark, f"{tmp_path}/t")
    store.create(spark.range(100).select("id", slow("id").alias("twice")), ["twice"], files=4)
    assert seen.value == 100
    assert sorted(r.twice for r in store.read().collect()) == [2 * k for k in range(100)]
    assert not [f for f in (tmp_path / "t").iterdir() if f.name.startswith("copy-")]


@pytest.mark.parametrize("text,want", [("\n In vest ment is up", True), ("Investment is up", False), ("Invest ments", False), ("o utlook", True), ("", False), (None, False), ("x" * 6000 + " out look", False), ("a re se arch", True)])
def test_broken_words(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(broken_word(F.col("x"))).first()[0] is want


@pytest.mark.parametrize("name,tables", [("classification", ["lineitem", "orders"]), ("same_asset_peers", ["lineitem"]), ("rollup_daily_dims", ["events"])])
def test_parts_grow_with_the_rows(spark, sf, monkeypatch, name, tables):
    """Groups, windows and joins stay in parts whose number follows from the rows; results are the same."""
    want = sorted(map(str, QUERIES[name](spark, sf).collect()))
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for t in tables:
        parts = -(-spark.read.parquet(f"{sf}/{t}.parquet").count() // 100)
        assert f", {parts}), REPARTITION_BY_NUM" in plan
    assert sorted(map(str, df.collect())) == want
