"""Feeds, sinks, HTML and streams on small fixtures written for the tests."""

import datetime as dt
import json
from decimal import Decimal

from pyspark.sql import functions as F

from lodestream.operators.text import robots_verdict
from lodestream.plans.documents import quotes_in
from lodestream.sources import feeds, html, sinks
from lodestream.streaming import jobs


def text(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "raw string").withColumn("fetched", F.lit("2026-01-01").cast("timestamp")).withColumn("series", F.lit("S")).withColumn("line", F.lit("1"))


def test_series(spark):
    bls = json.dumps({"Results": {"series": [{"seriesID": "X", "data": [{"year": "2026", "period": "M01", "value": "1,000.5", "footnotes": [{"code": "P"}]}, {"year": "2025", "period": "M12", "value": "..", "footnotes": []}, {"year": "2025", "period": "M11", "value": "2", "footnotes": []}, {"year": "2025", "period": "M13", "value": "9", "footnotes": []}]}]}})
    got = feeds.bls_series(text(spark, bls, "not json"), "raw", "fetched").collect()
    assert [(r.series, r.period, r.value, r.status) for r in got] == [("X", dt.date(2026, 1, 1), Decimal("1000.5"), "PRELIMINARY"), ("X", dt.date(2025, 11, 1), 2, "PUBLISHED")]
    fred = json.dumps({"observations": [{"realtime_start": "2026-02-01", "date": "2026-01-01", "value": "3.1"}, {"realtime_start": "2026-02-01", "date": "2025-12-01", "value": "."}]})
    assert [r.value for r in feeds.fred_series(text(spark, fred), "raw", "series").collect()] == [Decimal("3.1")]
    eia = json.dumps({"response": {"data": [{"period": "2026-01-02", "series": "S", "value": "5", "units": "x"}, {"period": "2026-01-02", "series": "T", "value": "6", "units": "x"}]}})
    assert [r.value for r in feeds.eia_series(text(spark, eia), "raw", "series", "fetched").collect()] == [5.0]
    bea = json.dumps({"BEAAPI": {"Results": {"Data": [{"TableName": "T", "LineNumber": "1", "TimePeriod": "2026M5", "DataValue": "7"}, {"TableName": "T", "LineNumber": "1", "TimePeriod": "2026Q2", "DataValue": "8"}, {"TableName": "T", "LineNumber": "2", "TimePeriod": "2026", "DataValue": "9"}]}}})
    assert sorted((r.period, r.value) for r in feeds.bea_series(text(spark, bea), "raw", "line", "fetched").collect()) == [(dt.date(2026, 4, 1), 8.0), (dt.date(2026, 5, 1), 7.0)]


def test_text_feeds(spark):
    ical = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:u1\r\nSUMMARY:Jobs \r\n report\r\nDTSTART;TZID=x:20260109T133000Z\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:u2\r\nSUMMARY:Day\r\nDTSTART;VALUE=DATE:20260710\r\nSTATUS:CANCELLED\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:u3\r\nSUMMARY:Local\r\nDTSTART:20260110T0900\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:No id\r\nDTSTART:20260110T0900\r\nEND:VEVENT\r\n"
    assert sorted((r.uid, r.summary, str(r.starts), r.status) for r in feeds.ical_events(text(spark, ical), "raw").collect()) == [("u1", "Jobs report", "2026-01-09 13:30:00", "SCHEDULED"), ("u2", "Day", "2026-07-10 12:30:00", "CANCELLED"), ("u3", "Local", "2026-01-10 14:00:00", "SCHEDULED")]
    smap = "<urlset><url><loc>http://a/?x=1&amp;y=2</loc><lastmod>2026-01-02T00:00:00Z</lastmod></url><url><loc> http://b </loc></url></urlset>"
    assert [(r.kind, r.url, r.lastmod) for r in feeds.sitemap_urls(text(spark, smap), "raw").collect()] == [("url", "http://a/?x=1&y=2", dt.date(2026, 1, 2)), ("url", "http://b", None)]
    rss = "<rss><item><title><![CDATA[A & B]]></title><link>http://x</link><pubDate>Fri, 09 Jan 2026 10:00:00 GMT</pubDate></item></rss>"
    r = feeds.rss_items(text(spark, rss), "raw").first()
    assert (r.title, r.link, str(r.published)) == ("A & B", "http://x", "2026-01-09 10:00:00")
    robots = "Allow: /first\nUser-agent: a\nUser-agent: b\nDisallow: /x # no\nAllow: /x/y\nCrawl-delay: 2.5\n\nUser-agent: free\nDisallow:\n\nUser-agent: *\nDisallow: /\n"
    got = feeds.robots_rules(text(spark, robots).withColumn("host", F.lit("h")), "raw", "host").collect()
    assert {x.agent for x in got if x.crawl_delay == 2.5} == {"a", "b"}
    assert sorted((x.agent, x.verdict or "", x.pattern or "") for x in got) == [("*", "allow", "/first"), ("*", "disallow", "/"), ("a", "allow", "/x/y"), ("a", "disallow", "/x"), ("b", "allow", "/x/y"), ("b", "disallow", "/x"), ("free", "", "")]
    low, high = feeds.policy_range(F.col("raw"))
    rows = text(spark, "keep the rate at 2-3/8 to 2-5/8 percent for now", "moved to 0 to 1/8 percent", "to 3 to 2 percent", "none").select(low.alias("l"), high.alias("h")).collect()
    assert [(r.l, r.h) for r in rows] == [(2.375, 2.625), (0.0, 0.125), (None, None), (None, None)]
    cal = json.dumps([{"title": "a", "date": "2026-01-01T08:00:00-05:00"}, {"title": "b", "date": "2026-01-01T08:00:00"}])
    assert [(r.title, str(r.ts)) for r in feeds.calendar_feed(text(spark, cal), "raw").collect()] == [("a", "2026-01-01 13:00:00")]
    assert [str(r.to_day) for r in feeds.year_chunks(spark, "2024-01-01", "2025-06-30").collect()] == ["2024-12-31", "2025-06-30"]


def test_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("﻿ticker,timestamp,value\nA,2026-01-01T00:00:00Z,5\nB,bad,1\nC,2026-01-01T00:00:00Z,-1\n", encoding="utf-8")
    good, bad = feeds.read_prices(spark, str(tmp_path / "p.csv"))
    assert [r.ticker for r in good.collect()] == ["A"] and bad.count() == 2
    (tmp_path / "s.csv").write_text('FREQ,AREA,TIME_PERIOD,OBS_VALUE,OBS_STATUS\nM,"a, ""b""",2026-01,1.5,A\nM,c,2026-02,,A\n')
    r = feeds.read_sdmx(spark, str(tmp_path / "s.csv")).collect()
    assert [(x.dimensions, x.value) for x in r] == [({"FREQ": "M", "AREA": 'a, "b"'}, 1.5)]


def test_sinks(spark, tmp_path):
    now = spark.createDataFrame([("a", 1, 10), ("b", 1, 20)], "k string, t int, v int")
    assert {(r.k, r.v) for r in sinks.upserted(now, spark.createDataFrame([("b", 0, 7), ("c", 1, 8)], "k string, t int, v int"), ["k"], "t").collect()} == {("a", 10), ("b", 7), ("c", 8)}
    assert {(r.k, r.v) for r in sinks.counted(now.drop("t"), spark.createDataFrame([("a", 1)], "k string, v int"), ["k"], ["v"]).collect()} == {("a", 11), ("b", 20)}
    fresh = spark.createDataFrame([("a", 2, 10), ("b", 2, 21), ("c", 2, 1)], "k string, t int, v int")
    assert {r.k for r in sinks.change_only(now, fresh, ["k"], "t", ["v"]).collect()} == {"b", "c"}
    path = str(tmp_path / "days")
    rows = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "day string, n int")
    for _ in range(2):
        sinks.rebuild_days(rows, path)
    assert spark.read.parquet(path).count() == 2
    sinks.rebuild_days(rows.where("n = 1"), path, ["2024-01-01", "2024-01-02"])
    assert [r.n for r in spark.read.parquet(path).collect()] == [1]
    dated = rows.withColumn("day", F.col("day").cast("date"))
    assert sinks.pruned(dated, "day", "2024-01-03", "1").count() == 1 and sinks.pruned(dated, "day", "2024-01-03", "x").count() == 2
    got, lost = sinks.compare_and_set(spark.createDataFrame([(1, 4)], "id int, version int"), spark.createDataFrame([(1, 4), (1, 3), (2, 1)], "id int, version int"), "id")
    assert [r.version for r in got.collect()] == [5] and lost.count() == 2
    cur = spark.createDataFrame([(1, "x" * 1000), (2, "x" * 1000)], "id int, text string")
    act = sinks.replace_if_better(cur, spark.createDataFrame([(1, "x" * 1499), (2, "x" * 1500), (3, "y")], "id int, text string"), "id", "text")
    assert {r.id: r.action for r in act.collect()} == {1: "duplicate", 2: "replace", 3: "insert"}


def test_revisions(spark):
    stored = spark.createDataFrame([("s", "p", 7.5, "F", "2026-01-01", 0), ("s", "r", 1.0, "F", "2026-01-01", 0), ("s", "r", 2.0, "F", "2026-01-05", 1)], "series string, period string, value double, status string, vintage string, revision_no long")
    arrivals = spark.createDataFrame([("s", "p", 7.5, "F", "2026-01-02"), ("s", "p", 8.5, "F", "2026-01-03"), ("s", "p", 8.75, "F", "2026-01-04"), ("s", "q", 1.0, "F", "2026-01-01")], "series string, period string, value double, status string, vintage string")
    new, bad = sinks.revised(stored, arrivals, ["series", "period"])
    assert sorted((r.period, r.value, r.revision_no) for r in new.collect()) == [("p", 8.5, 1), ("p", 8.75, 2), ("q", 1.0, 0)] and bad.count() == 0
    _, bad = sinks.revised(stored, spark.createDataFrame([("s", "p", 9.0, "F", "2025-12-01")], arrivals.schema), ["series", "period"])
    assert bad.count() == 1
    old = [("s", "r", 1.0, "F", "2026-01-01"), ("s", "r", 2.0, "F", "2026-01-02"), ("s", "r", 3.0, "F", "2026-01-05"), ("s", "r", 3.0, "F", "2026-01-04")]
    new, bad = sinks.revised(stored, spark.createDataFrame(old, arrivals.schema), ["series", "period"])
    assert new.count() == 0 and sorted(r.vintage for r in bad.collect()) == ["2026-01-04", "2026-01-05"]


def test_quotes(spark):
    texts = spark.createDataFrame([(1, "He said: To  be, or\nnot to be."), (2, "nothing"), (3, None), (4, "endsing well enough here today")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "to be, or not to be"), (2, "or not"), (3, "be, or not"), (4, "ends"), (5, ""), (6, None), (7, "well enough here today"), (8, "ing well enough here tod")], "item_id long, text string")
    assert sorted((r.item_id, r.doc_id) for r in quotes_in(texts, quotes).collect()) == [(1, 1), (2, 1), (3, 1), (4, 4), (7, 4), (8, 4)]
    assert quotes_in(texts, quotes.limit(0)).count() == 0


def test_robots_verdict(spark):
    rows = spark.createDataFrame([("/a/b",), ("/c",), ("/p.gif",)], "path string")
    said = lambda rules: [r[0] for r in rows.select(robots_verdict(F.col("path"), rules)).collect()]
    assert said([("disallow", "/a")]) == [False, True, True] and said([]) == [True, True, True] and said([("allow", "/")]) == [True, True, True]
    assert said([("disallow", "/*.gif$"), ("allow", "/p.gif")]) == [True, True, True]


def test_html(spark):
    page = "<html><title>T</title><nav><p>" + "menu " * 20 + "</p></nav><h2>Head</h2><p>" + "word " * 20 + "</p><ul><li>item one</li></ul><table><tr><th colspan=2>a</th></tr><tr><td>1</td><td>2</td></tr></table><table><tr><td>x</td></tr></table></html>"
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    r = {x.page_id: x for x in html.article(pages).collect()}
    assert r[1].title == "T" and r[1].body == ("word " * 20).strip() + "\n• item one" and r[2].body == ""
    t = html.tables(pages).collect()
    assert [(x.n_rows, x.n_cols, x.cells) for x in t] == [(2, 2, [["a", "a"], ["1", "2"]])]


def finished(query):
    query.processAllAvailable()
    query.stop()


def test_streams_equal_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "in")
    spark.read.parquet(f"{sf}/events.parquet").repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(folder)
    stream = jobs.event_stream(spark, folder)
    finished(jobs.hourly(stream).writeStream.outputMode("complete").format("memory").queryName("hourly").start())
    batch = events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").count()
    assert {(r.hour, r.event_type, r.n) for r in spark.table("hourly").collect()} == {(r.hour, r.event_type, r["count"]) for r in batch.collect()}
    job = jobs.write_daily(jobs.event_stream(spark, folder), str(tmp_path / "out"), str(tmp_path / "check"))
    job.awaitTermination(120)
    daily = spark.read.parquet(str(tmp_path / "out" / "daily"))
    want = events.groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").count()
    assert {(str(r.day), r.event_type, r.n) for r in daily.collect()} == {(r.day, r.event_type, r["count"]) for r in want.collect()}
    finished(jobs.error_streaks(stream, 2).writeStream.outputMode("append").format("memory").queryName("streaks").start())
    assert spark.table("streaks").count() >= 0


def test_market_quotes(spark):
    payload = '{"meta": {"symbol": "X"}, "values": [{"datetime": "2026-09-02 15:30:00", "open": "1.5", "high": "2", "low": "1", "close": "1.75"}, {"datetime": "bad", "close": "1"}, {"datetime": "2026-09-03", "open": null, "close": "N/A"}, {"datetime": "2026-09-04", "close": "1,000"}]}'
    got = {str(r.ts): (r.symbol, r.open, r.close) for r in feeds.market_quotes(spark.createDataFrame([(payload,), (None,), ("{}",)], "t string"), "t").collect()}
    assert got == {"2026-09-02 15:30:00": ("X", Decimal("1.5"), Decimal("1.75")), "2026-09-04 00:00:00": ("X", None, Decimal(1000))}


def test_series_keep_all_digits(spark):
    payload = '{"observations": [{"realtime_start": "2026-09-01", "date": "2026-07-01", "value": "1e-30"}, {"realtime_start": "2026-09-01", "date": "2026-08-01", "value": "12,345.60"}, {"realtime_start": "2026-09-01", "date": "2026-09-01", "value": "."}]}'
    got = {str(r.period): (r.value, r.value_text) for r in feeds.fred_series(spark.createDataFrame([(payload, "S")], "t string, s string"), "t", "s").collect()}
    assert got == {"2026-07-01": (None, "0." + "0" * 29 + "1"), "2026-08-01": (Decimal("12345.6"), "12345.6")}


def test_frozen_fills_only_what_is_missing(spark):
    have = spark.createDataFrame([(1, 5, "a"), (2, None, "b"), (3, None, "c")], "id int, x int, n string")
    fresh = spark.createDataFrame([(1, 9), (2, 7), (4, 1)], "id int, x int")
    assert {tuple(r) for r in sinks.frozen(have, fresh, "id", "x").select("id", "x", "n").collect()} == {(1, 5, "a"), (2, 7, "b"), (3, None, "c")}


def test_shards_hold_their_rows_only(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "id % 3 AS shard")
    for _ in range(2):  # written again: the same
        sinks.write_shards(rows, "shard", f"{tmp_path}/s")
    assert {(r.shard, r.n, r.least) for r in spark.read.parquet(f"{tmp_path}/s").groupBy("shard").agg(F.count("*").alias("n"), F.min("id").alias("least")).collect()} == {(0, 34, 0), (1, 33, 1), (2, 33, 2)}
