"""Copy-on-write tables, the publication gate and stored verdicts."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestream.operators.gate import INPUTS, eligibility, gate_issues, refresh_verdicts
from lodestream.sources.versioned import Conflict, VersionedTable


@pytest.fixture
def store(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.create(spark.range(200).select("id", (F.col("id") % 7).alias("k"), F.concat(F.lit("s"), "id").alias("s")), ["id"], 8)
    return t


def duck(store, version=None):
    con = duckdb.connect()
    rows = store.read(version).toPandas()
    con.register("t0", rows)
    con.execute("CREATE TABLE t AS SELECT * FROM t0")
    return con


def same(store, con):
    assert sorted(map(tuple, store.read().collect()), key=str) == sorted(con.execute("SELECT * FROM t").fetchall(), key=str)


def test_update_from_equals_sql_and_leaves_files_alone(spark, store):
    con = duck(store)
    before = store.files()
    store.update_from(spark.createDataFrame([(3, "x"), (4, None), (199, "z"), (None, "n"), (None, "m")], "i long, v string"), {"id": "i"}, {"s": F.concat("o.v", F.lit("-"), "t.s"), "k": F.lit(99)})
    con.execute("CREATE TABLE o AS SELECT * FROM (VALUES (3, 'x'), (4, NULL), (199, 'z')) v(i, v)")
    con.execute("UPDATE t SET s = o.v || '-' || t.s, k = 99 FROM o WHERE t.id = o.i")
    same(store, con)
    assert len(set(before) & set(store.files())) == len(before) - 2  # two files hold the three rows
    assert store.read(0).where("k = 99").count() == 0  # older versions keep their rows


def test_update_from_narrowed_pairs_and_repeats(spark, store):
    other = spark.createDataFrame([(1, 50), (2, 1000)], "k2 long, most long")
    con = duck(store)
    store.update_from(other, {"k": "k2"}, {"s": F.lit("low")}, where=F.expr("t.id < o.most"))
    con.execute("UPDATE t SET s = 'low' WHERE (k = 1 AND id < 50) OR k = 2")
    same(store, con)
    version = store.version()
    assert store.update_from(spark.createDataFrame([(77,)], "k2 long"), {"k": "k2"}, {"s": F.lit("never")}) == version == store.version()
    with pytest.raises(ValueError, match="repeat a key"):
        store.update_from(spark.createDataFrame([(1, "a"), (1, "b")], "k2 long, v string"), {"k": "k2"}, {"s": F.col("o.v")})


def test_delete_by_condition_and_subquery(spark, store):
    con = duck(store)
    before = store.files()
    store.delete_where(F.when(F.col("id") > 5, F.col("id") >= 190))  # null counts as false
    con.execute("DELETE FROM t WHERE id >= 190")
    same(store, con)
    assert len(set(before) - set(store.files())) == 1
    one = spark.createDataFrame([("x", 5), ("y", 5)], "n string, k2 long")
    store.delete_where(F.col("s").rlike("^s[0-9]{2}$"), one, {"k": "k2"})
    con.execute("DELETE FROM t WHERE k = 5 AND regexp_matches(s, '^s[0-9]{2}$')")
    same(store, con)
    version = store.version()
    assert store.delete_where(F.col("id") > 10_000) == version


def test_upsert_append_and_schema(spark, store):
    con = duck(store)
    store.upsert(spark.createDataFrame([(7, 1, "new"), (900, 2, "more"), (None, 3, "null")], "id long, k long, s string"), ["id"])
    con.execute("DELETE FROM t WHERE id = 7; INSERT INTO t VALUES (7, 1, 'new'), (900, 2, 'more'), (NULL, 3, 'null')")
    same(store, con)
    store.upsert(spark.createDataFrame([(None, 4, "again")], "id long, k long, s string"), ["id"])
    assert [r.s for r in store.read().where("id IS NULL").collect()] == ["again"]
    files = set(store.files())
    store.append(spark.createDataFrame([(1000, 1, "a")], "id long, k long, s string"))
    assert files < set(store.files()) and store.read().columns == ["id", "k", "s"]
    version = store.version()
    assert store.upsert(store.read().limit(0), ["id"]) == version


def test_two_writers_of_one_version(spark, store):
    other = VersionedTable(spark, store.path)
    base = other.version()
    store.delete_where(F.col("id") == 1)
    with pytest.raises(Conflict):
        other._commit(base, "id long", [])
    assert other.version() == base + 1 and other.read().count() == 199


def test_empty_table(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/e")
    assert t.version() == -1
    t.create(spark.createDataFrame([], "id long, s string"))
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([(1, "a")], "id long, s string"), ["id"])
    assert t.delete_where(F.lit(True)) == 2 and t.read().count() == 0


# --- gate ---------------------------------------------------------------------------------------

LONG = "Growth slowed in the second quarter as exports fell and households saved more than before. " * 5
GOOD = {"title": "Growth slows as exports fall", "text": LONG, "url": "https://example.org/a", "language": "en", "summary": "Growth slows.", "review_status": "ok"}
CASES = [
    ({}, [], ["empty_summary", "missing_translation"]),
    ({"title": "PDF 777 Kb"}, ["abnormal_title"], None), ({"title": "Download the document now"}, ["abnormal_title"], None), ({"title": "Research"}, ["abnormal_title"], None),
    ({"title": "Q3 2026: 1.4 %"}, ["abnormal_title"], None), ({"title": "x" * 181}, ["abnormal_title"], None), ({"title": "Download the report on earnings"}, [], None),
    ({"title": "Annual report (file, 12 MB)"}, ["abnormal_title"], None), ({"title": "Profile of a market"}, [], None),
    ({"text": "ARTICLE COMING  SOON " + LONG}, ["placeholder_content"], None), ({"title": "Article coming soon"}, ["placeholder_content"], None),
    ({"text": "The fore ca st is weak. " + LONG}, ["garbled_or_broken_words"], None), ({"text": "The fore cast is weak. " + LONG}, [], None), ({"text": "The in vest ment case. " + LONG}, ["garbled_or_broken_words"], None),
    ({"text": "Itâ€™s weak. " + LONG}, ["garbled_or_broken_words"], None), ({"text": "a�b " + LONG}, ["garbled_or_broken_words"], None),
    ({"text": "Short."}, ["thin_content"], None), ({"text": None}, ["thin_content"], None), ({"summary": "  "}, ["empty_summary"], None),
    ({"url": "ftp://x"}, ["missing_source"], None), ({"url": None}, ["missing_source"], None),
    ({"title": "黄金 market outlook for the year"}, ["source_language_mismatch"], None), ({"review_status": "needs_review"}, ["analysis_needs_review"], None),
    ({"review_status": None, "summary": None}, ["empty_summary"], None),
    ({"translation_title": "黄金展望", "translation_text": "出口下降，增长放缓。"}, [], []),
    ({"translation_title": "Gold", "translation_text": "exports fall"}, [], ["translation_language_mismatch"]),
    ({"translation_title": "黄金", "translation_text": "# 标题\n- "}, [], ["empty_summary"]),
    ({"translation_title": "黄金", "translation_text": "# 完整\n"}, [], ["empty_summary"]),
    ({"translation_title": "黄金", "translation_text": "�出口"}, [], ["translation_garbled"]),
    ({"language": "zh-CN", "title": "黄金市场展望与风险分析报告", "text": "出口下降增长放缓。" * 60}, [], []),
    ({"title": "黄金市场展望与风险分析", "text": "出口下降增长放缓。" * 60}, [], []),
]


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(k, *[(GOOD | case[0]).get(c) for c in INPUTS]) for k, case in enumerate(CASES)]
    a = spark.createDataFrame(rows, "k int, " + ", ".join(f"{c} string" for c in INPUTS))
    given = {c: F.col(c) for c in INPUTS}
    a = a.withColumn("en", gate_issues("en", **given)).withColumn("zh", gate_issues("zh-CN", **given))
    return {r.k: r for r in a.withColumn("e", eligibility(F.col("title"), F.col("text"), F.col("url"), F.col("en"))).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_gate(judged, k):
    given, en, zh = CASES[k]
    assert judged[k].en == en
    if zh is not None:
        assert judged[k].zh == zh
    empty = (GOOD | given)["text"] is None or (GOOD | given)["url"] is None
    assert judged[k].e == ("NOT_GENERATED" if empty else "NOINDEX_FOLLOW" if en else "INDEX")


def test_verdicts_are_computed_where_something_changed(spark, tmp_path):
    store = VersionedTable(spark, f"file://{tmp_path}/v")
    cells = lambda changed: [(k, *[(GOOD | changed.get(k, {})).get(c) for c in INPUTS]) for k in range(60) if changed.get(k, {}) is not None]
    rows = lambda changed: spark.createDataFrame(cells(changed), "id long, " + ", ".join(f"{c} string" for c in INPUTS))
    assert refresh_verdicts(store, rows({}), "id", 1) == 60
    version, files = store.version(), store.files()
    assert refresh_verdicts(store, rows({}), "id", 1) == 0 and (store.version(), store.files()) == (version, files)  # nothing changed, nothing done
    changed = {3: {"title": "Report"}, 4: {"text": "Short."}, 5: None, 6: {"summary_zh": ""}}
    assert refresh_verdicts(store, rows(changed), "id", 1) == 3  # null and empty differ
    assert set(files) & set(store.files())
    full = VersionedTable(spark, f"file://{tmp_path}/full")
    refresh_verdicts(full, rows(changed), "id", 1)
    assert sorted(map(str, store.read().collect())) == sorted(map(str, full.read().collect()))
    assert {r.id for r in store.read().where("NOT indexable_en").collect()} == {3, 4} and store.read().where("id = 5").count() == 0
    assert refresh_verdicts(store, rows(changed), "id", 2) == 59 and store.read().where("rules = 2").count() == 59  # other rules: all again
