"""Every registered query of the library's own operators equals its SQL on the smallest tables."""

import os

import duckdb
import pytest

from lodestream.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    got = sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(map(str, r)))
    asked = duck.execute(SQL[name])
    columns = [c[0] for c in asked.description]
    assert sorted(columns) == sorted(df.columns)
    want = [tuple(dict(zip(columns, r, strict=True))[c] for c in df.columns) for r in asked.fetchall()]
    assert got == sorted(want, key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf):
    rows = QUERIES[name](spark, sf).count()
    assert rows > 0 or name == "html_tables"  # the pages hold no tables


def test_entry_names():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
