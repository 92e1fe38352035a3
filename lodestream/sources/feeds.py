"""Feeds as DataFrames: JSON series of statistics agencies, SDMX-CSV, price CSV, iCalendar, sitemaps, robots, RSS, quotes.

Each function takes rows of raw text (a column per payload), so a feed of any
number of files is parsed in parallel; malformed payloads give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions.scalar import decimal_string, decimal_text, period_start



def _series(rows: DataFrame) -> DataFrame:
    """What all series parsers return: the number as text, digit for digit, and as a decimal (null where that cannot hold it)."""
    text = decimal_string(F.col("value"))
    return rows.select("series", "period", decimal_text(F.col("value")).alias("value"), "status", "vintage", text.alias("value_text")).where("value_text IS NOT NULL AND period IS NOT NULL")


def bls_series(raw: DataFrame, text: str, fetched: str) -> DataFrame:
    """Monthly rows M01 to M12; a footnote P makes a value preliminary. The vintage is the time of the fetch."""
    schema = "Results STRUCT<series: ARRAY<STRUCT<seriesID: STRING, data: ARRAY<STRUCT<year: STRING, period: STRING, value: STRING, footnotes: ARRAY<STRUCT<code: STRING>>>>>>>"
    rows = raw.select(F.explode(F.from_json(text, schema)["Results"]["series"]).alias("s"), F.col(fetched).alias("vintage"))
    rows = rows.select(F.col("s.seriesID").alias("series"), F.explode("s.data").alias("d"), "vintage").where(F.col("d.period").rlike("^M(0[1-9]|1[0-2])$"))
    early = F.exists(F.coalesce("d.footnotes", F.array().cast("array<struct<code:string>>")), lambda f: f["code"] == "P")
    period = F.concat("d.year", F.lit("-"), F.substring("d.period", 2, 2))
    return _series(rows.select("series", period_start(period).alias("period"), F.col("d.value").alias("value"), F.when(early, "PRELIMINARY").otherwise("PUBLISHED").alias("status"), "vintage"))


def fred_series(raw: DataFrame, text: str, series: str) -> DataFrame:
    """Observations whose realtime start is the vintage; ``.`` is a missing value."""
    rows = raw.select(F.col(series).alias("series"), F.explode(F.from_json(text, "observations ARRAY<STRUCT<realtime_start: STRING, date: STRING, value: STRING>>")["observations"]).alias("o"))
    return _series(rows.select("series", period_start(F.col("o.date")).alias("period"), F.col("o.value").alias("value"), F.lit("PUBLISHED").alias("status"), F.col("o.realtime_start").try_cast("timestamp").alias("vintage")))


def eia_series(raw: DataFrame, text: str, series: str, fetched: str) -> DataFrame:
    """Rows of the asked series; others are dropped."""
    rows = raw.select(F.col(series).alias("series"), F.explode(F.from_json(text, "response STRUCT<data: ARRAY<STRUCT<period: STRING, series: STRING, value: STRING, units: STRING>>>")["response"]["data"]).alias("o"), F.col(fetched).alias("vintage"))
    return _series(rows.where("o.series = series").select("series", period_start(F.col("o.period")).alias("period"), F.col("o.value").alias("value"), F.lit("PUBLISHED").alias("status"), "vintage"))


def bea_series(raw: DataFrame, text: str, line: str, fetched: str) -> DataFrame:
    """Rows of one line of a table; 2026M5 reads as 2026-05, 2026Q2 as a quarter."""
    schema = "BEAAPI STRUCT<Results: STRUCT<Data: ARRAY<STRUCT<TableName: STRING, LineNumber: STRING, TimePeriod: STRING, DataValue: STRING>>>>"
    rows = raw.select(F.explode(F.from_json(text, schema)["BEAAPI"]["Results"]["Data"]).alias("o"), F.col(line).alias("line"), F.col(fetched).alias("vintage")).where("o.LineNumber = line")
    t = F.col("o.TimePeriod")
    month = F.concat(F.substring(t, 1, 4), F.lit("-"), F.lpad(F.regexp_extract(t, r"M(\d{1,2})$", 1), 2, "0"))
    period = F.when(t.rlike(r"^\d{4}M\d{1,2}$"), month).when(t.rlike(r"^\d{4}Q[1-4]$"), F.concat(F.substring(t, 1, 4), F.lit("-"), F.substring(t, 5, 2))).otherwise(t)
    return _series(rows.select(F.col("o.TableName").alias("series"), period_start(period).alias("period"), F.col("o.DataValue").alias("value"), F.lit("PUBLISHED").alias("status"), "vintage"))


def market_quotes(raw: DataFrame, text: str) -> DataFrame:
    """(symbol, ts, open, high, low, close) of a time-series payload."""
    rows = raw.select(F.from_json(text, "meta STRUCT<symbol: STRING>, values ARRAY<STRUCT<datetime: STRING, open: STRING, high: STRING, low: STRING, close: STRING>>").alias("p"))
    rows = rows.select(F.col("p.meta.symbol").alias("symbol"), F.explode("p.values").alias("v"))
    return rows.select("symbol", F.col("v.datetime").try_cast("timestamp").alias("ts"), *[decimal_text(F.col(f"v.{c}")).alias(c) for c in ("open", "high", "low", "close")]).where("ts IS NOT NULL AND close IS NOT NULL")


def calendar_feed(raw: DataFrame, text: str) -> DataFrame:
    """(title, ts) of calendar rows; times without an offset are refused."""
    rows = raw.select(F.explode(F.from_json(text, "ARRAY<STRUCT<title: STRING, date: STRING>>")).alias("e"))
    return rows.where(F.col("e.date").rlike(r"(Z|[+-]\d{2}:?\d{2})$")).select("e.title", F.col("e.date").try_cast("timestamp").alias("ts")).where("ts IS NOT NULL")


def read_prices(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows (ticker, ts, value) and rejected lines of price files with a header; a byte-order mark is stripped."""
    lines = spark.read.schema("ticker STRING, timestamp STRING, value STRING, _corrupt_record STRING").csv(path, header=True, mode="PERMISSIVE", enforceSchema=True)
    ticker = F.trim(F.regexp_replace("ticker", "^﻿", ""))
    rows = lines.select(ticker.alias("ticker"), F.col("timestamp").try_cast("timestamp").alias("ts"), decimal_text(F.col("value")).alias("value"), "_corrupt_record")
    good = F.coalesce((F.col("ticker") != "") & F.col("ts").isNotNull() & (F.col("value") > 0) & F.col("_corrupt_record").isNull(), F.lit(False))
    return rows.where(good).drop("_corrupt_record"), rows.where(~good)


def read_sdmx(spark: SparkSession, path: str) -> DataFrame:
    """SDMX-CSV files: (dimensions map, period, value, status, unit); TIME_PERIOD and OBS_VALUE must exist."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    if not {"TIME_PERIOD", "OBS_VALUE"} <= set(rows.columns):
        raise ValueError("an SDMX-CSV needs TIME_PERIOD and OBS_VALUE")
    control = {"TIME_PERIOD", "OBS_VALUE", "OBS_STATUS", "UNIT_MEASURE", "DATAFLOW", "STRUCTURE", "STRUCTURE_ID", "ACTION"}
    pairs = [x for c in rows.columns if c not in control for x in (F.lit(c), F.col(f"`{c}`"))]
    dimensions = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull() & (v != "")) if pairs else F.create_map().cast("map<string,string>")
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    return rows.select(dimensions.alias("dimensions"), period_start(F.col("TIME_PERIOD")).alias("period"), decimal_text(F.col("OBS_VALUE")).alias("value"), have("OBS_STATUS").alias("status"), have("UNIT_MEASURE").alias("unit")).where("value IS NOT NULL AND period IS NOT NULL")


def ical_events(raw: DataFrame, text: str, zone: str = "America/New_York", day_time: str = "08:30:00") -> DataFrame:
    """(uid, summary, starts, status) of calendar files: folded lines are joined, then events split.

    Times with Z are UTC, others are wall-clock times of ``zone``; a day alone is at ``day_time`` there. Events
    without a uid or a start are left out; a status other than CANCELLED is SCHEDULED.
    """
    flat = F.regexp_replace(F.col(text), r"\r?\n[ \t]", "")
    rows = raw.select(F.explode(F.slice(F.split(flat, "BEGIN:VEVENT"), F.lit(2), F.lit(1_000_000))).alias("e"))
    field = lambda name: F.trim(F.regexp_extract("e", rf"(?m)^{name}(?:;[^:\n]*)?:([^\r\n]*)", 1))
    start = field("DTSTART")
    full = F.when(start.rlike(r"^\d{8}$"), F.concat(start, F.lit("T"), F.lit(day_time.replace(":", "")))).otherwise(F.regexp_replace(start, "Z$", ""))
    full = F.when(full.rlike(r"T\d{4}$"), F.concat(full, F.lit("00"))).otherwise(full)
    ts = F.try_to_timestamp(full, F.lit("yyyyMMdd'T'HHmmss"))
    starts = F.when(start.endswith("Z"), ts).otherwise(F.to_utc_timestamp(ts, zone))
    status = F.when(field("STATUS") == "CANCELLED", "CANCELLED").otherwise("SCHEDULED")
    return rows.select(field("UID").alias("uid"), field("SUMMARY").alias("summary"), starts.alias("starts"), status.alias("status")).where("starts IS NOT NULL AND uid <> ''")


def sitemap_urls(raw: DataFrame, text: str) -> DataFrame:
    """(kind, url, lastmod) of sitemap files: urls of a set, or of an index."""
    entry = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?s)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), 1)).alias("e")
    rows = raw.select(F.when(F.contains(F.col(text), F.lit("<sitemapindex")), "index").otherwise("url").alias("kind"), entry)
    url = F.trim(F.replace(F.regexp_extract("e", r"(?s)<loc>(.*?)</loc>", 1), F.lit("&amp;"), F.lit("&")))
    return rows.select("kind", url.alias("url"), F.regexp_extract("e", r"<lastmod>\s*([0-9-]{10})", 1).try_cast("date").alias("lastmod")).where("url <> ''")


def rss_items(raw: DataFrame, text: str) -> DataFrame:
    """(title, link, published) of RSS items and Atom entries."""
    rows = raw.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?s)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), 1)).alias("e"))
    plain = lambda c: F.trim(F.regexp_replace(c, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))
    link = F.coalesce(F.nullif(plain(F.regexp_extract("e", r"(?s)<link>(.*?)</link>", 1)), F.lit("")), F.nullif(F.regexp_extract("e", r'<link[^>]*href="([^"]*)"', 1), F.lit("")))
    stamp = F.trim(F.regexp_extract("e", r"(?s)<(?:pubDate|updated|published)>(.*?)</", 1))
    ts = F.coalesce(stamp.try_cast("timestamp"), F.try_to_timestamp(F.regexp_extract(stamp, r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss")))
    return rows.select(plain(F.regexp_extract("e", r"(?s)<title[^>]*>(.*?)</title>", 1)).alias("title"), link.alias("link"), ts.alias("published")).where("link IS NOT NULL")


def robots_rules(raw: DataFrame, text: str, host: str) -> DataFrame:
    """(host, agent, verdict, pattern, crawl_delay) of robots files: groups of agents followed by their rules.

    Rules before any agent belong to ``*``. An agent whose group has no rule (an empty Disallow is none) has one row
    without a verdict: it is allowed everything and does not fall back to ``*``.
    """
    lines = raw.select(F.col(host).alias("host"), F.posexplode(F.split(F.col(text), r"\r?\n")).alias("pos", "line"))
    line = F.trim(F.regexp_replace("line", "#.*", ""))
    rows = lines.select("host", "pos", F.lower(F.trim(F.regexp_extract(line, "^([A-Za-z-]+)\\s*:", 1))).alias("k"), F.trim(F.regexp_extract(line, "^[A-Za-z-]+\\s*:(.*)$", 1)).alias("v"))
    rows = rows.where("k IN ('user-agent', 'allow', 'disallow', 'crawl-delay')")
    w = Window.partitionBy("host").orderBy("pos")  # one file's lines
    opens = (F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(w), F.lit("")) != "user-agent")
    rows = rows.withColumn("group_no", F.sum(opens.cast("int")).over(w))
    early = rows.where("group_no = 0 AND k IN ('allow', 'disallow')").select("host", "group_no", F.lit("*").alias("agent")).distinct()
    agents = rows.where("k = 'user-agent'").select("host", "group_no", F.lower("v").alias("agent")).union(early)
    rules = rows.where("k IN ('allow', 'disallow') AND NOT (k = 'disallow' AND v = '')").select("host", "group_no", F.col("k").alias("verdict"), F.col("v").alias("pattern"))
    delay = rows.where("k = 'crawl-delay' AND group_no > 0").groupBy("host", "group_no").agg(F.max_by(F.col("v").try_cast("double"), "pos").alias("crawl_delay"))
    return agents.join(rules, ["host", "group_no"], "left").join(delay, ["host", "group_no"], "left").select("host", "agent", "verdict", "pattern", "crawl_delay")


def policy_range(text: Column) -> tuple[Column, Column]:
    """Lower and upper bound of a policy rate such as 5-1/4 to 5-1/2 percent; null if the lower exceeds the upper."""
    number = r"(\d{1,2}(?:\.\d+)?(?:[- ]\d/\d)?|\d/\d)"
    pattern = rf"(?:at|to|of) {number} (?:to|and|-) {number} percent"

    def value(part: Column) -> Column:
        whole = F.regexp_extract(part, r"^(\d+(?:\.\d+)?)(?![/\d])", 1).try_cast("double")
        over, under = F.regexp_extract(part, r"(\d)/(\d)$", 1).try_cast("double"), F.regexp_extract(part, r"(\d)/(\d)$", 2).try_cast("double")
        return F.when(part != "", F.coalesce(whole, F.lit(0.0)) + F.coalesce(over / F.nullif(under, F.lit(0.0)), F.lit(0.0)))

    low, high = value(F.regexp_extract(text, pattern, 1)), value(F.regexp_extract(text, pattern, 2))
    return F.when(low <= high, low), F.when(low <= high, high)


def year_chunks(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Backfill ranges of a year each between two dates."""
    s = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("INTERVAL 1 YEAR"))).alias("from_day"))
    return s.select("from_day", F.least(F.date_sub(F.add_months("from_day", 12), 1), F.lit(end).cast("date")).alias("to_day"))
