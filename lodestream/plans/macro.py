"""Time series with vintages: monthly order totals stand for an indicator, three vintages revise each month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions.scalar import backoff_minutes, horizon_end, horizon_text, horizon_tokens, period_start
from lodestream.operators.relational import latest_per_key
from lodestream.plans.base import query
from lodestream.session import table

M = "m AS (SELECT date_trunc('month', o_orderdate)::DATE AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1)"
VIN = M + """, vin AS (SELECT period, k AS source_rank, round(value * (1 + CAST(0.001 AS DOUBLE) * k * (month(period) % 3 - 1)), 4) AS value, (last_day(period) + 30 * k::INT)::DATE AS vintage FROM m, range(3) r(k))"""


def monthly(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.to_date(F.trunc(F.to_date("o_orderdate"), "month")).alias("period")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


def vintages(spark: SparkSession, d: str) -> DataFrame:
    k = F.explode(F.sequence(F.lit(0), F.lit(2)))
    v = monthly(spark, d).select("period", "value", k.alias("k"))
    return v.select("period", F.col("k").cast("long").alias("source_rank"), F.round(F.col("value") * (1 + F.lit(0.001) * F.col("k") * (F.month("period") % 3 - 1)), 4).alias("value"), F.date_add(F.last_day("period"), F.col("k") * 30).alias("vintage"))


@query(f"WITH {VIN} SELECT period::VARCHAR AS period, max_by(value, vintage) AS value, max(vintage)::VARCHAR AS vintage FROM vin GROUP BY 1")
def vintage_latest_per_period(spark: SparkSession, d: str) -> DataFrame:
    v = latest_per_key(vintages(spark, d), ["period"], ["vintage"])
    return v.select(F.col("period").cast("string").alias("period"), "value", F.col("vintage").cast("string").alias("vintage"))


@query(f"""WITH {VIN}, l AS (SELECT *, lag(value) OVER (PARTITION BY period ORDER BY vintage) AS prev FROM vin), c AS (SELECT * FROM l WHERE prev IS NULL OR prev <> value)
SELECT period::VARCHAR AS period, vintage::VARCHAR AS vintage, value, row_number() OVER (PARTITION BY period ORDER BY vintage) - 1 AS revision_no FROM c""")
def revision_decision(spark: SparkSession, d: str) -> DataFrame:
    """Vintages in order of arrival: equal ones are unchanged and dropped, the others numbered from 0."""
    w = Window.partitionBy("period").orderBy("vintage")
    v = vintages(spark, d).withColumn("prev", F.lag("value").over(w)).where("prev IS NULL OR prev <> value")
    return v.select(F.col("period").cast("string").alias("period"), F.col("vintage").cast("string").alias("vintage"), "value", (F.row_number().over(w) - 1).cast("long").alias("revision_no"))


@query(f"""WITH {VIN} SELECT period::VARCHAR AS period, min_by(value, vintage) AS initial, max_by(value, vintage) AS latest, round(max_by(value, vintage) - min_by(value, vintage), 4) AS delta, round((max_by(value, vintage) - min_by(value, vintage)) / nullif(abs(min_by(value, vintage)), 0), 8) AS pct, count(DISTINCT value) - 1 AS revisions FROM vin GROUP BY 1""")
def revision_metrics(spark: SparkSession, d: str) -> DataFrame:
    g = vintages(spark, d).groupBy("period").agg(F.min_by("value", "vintage").alias("initial"), F.max_by("value", "vintage").alias("latest"), (F.count_distinct("value") - 1).alias("revisions"))
    delta = F.col("latest") - F.col("initial")
    return g.select(F.col("period").cast("string").alias("period"), "initial", "latest", F.round(delta, 4).alias("delta"), F.round(delta / F.nullif(F.abs("initial"), F.lit(0.0)), 8).alias("pct"), "revisions")


@query(f"""WITH {M}, s AS (SELECT period, value, lag(value) OVER (ORDER BY period) AS consensus FROM m), x AS (SELECT *, value - consensus AS surprise FROM s),
z AS (SELECT period, value, consensus, surprise, count(surprise) OVER w AS n, avg(surprise) OVER w AS mu, stddev_samp(surprise) OVER w AS sd FROM x WINDOW w AS (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT period::VARCHAR AS period, value, consensus, round(surprise, 4) AS surprise, round(surprise / nullif(abs(consensus), 0), 6) AS surprise_pct, CASE WHEN n >= 12 AND sd > 0 THEN round((surprise - mu) / sd, 6) END AS z FROM z""")
def surprise_zscore(spark: SparkSession, d: str) -> DataFrame:
    """Surprise against the month before and its z-score among earlier surprises (12 at least, sample deviation)."""
    by = Window.orderBy("period")  # one row per month
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    s = monthly(spark, d).withColumn("consensus", F.lag("value").over(by)).withColumn("s", F.col("value") - F.col("consensus"))
    s = s.withColumn("n", F.count("s").over(past)).withColumn("mu", F.avg("s").over(past)).withColumn("sd", F.stddev_samp("s").over(past))
    return s.select(F.col("period").cast("string").alias("period"), "value", "consensus", F.round("s", 4).alias("surprise"), F.round(F.col("s") / F.nullif(F.abs("consensus"), F.lit(0.0)), 6).alias("surprise_pct"),
                    F.when((F.col("n") >= 12) & (F.col("sd") > 0), F.round((F.col("s") - F.col("mu")) / F.col("sd"), 6)).alias("z"))


@query(f"""WITH {M}, c AS (SELECT period, value, value - lag(value) OVER w AS diff, lag(value, 3) OVER w AS l3, max(value) OVER (ORDER BY period ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS hi, min(value) OVER (ORDER BY period ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS lo FROM m WINDOW w AS (ORDER BY period)),
e AS (SELECT *, avg(diff) OVER (ORDER BY period ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS mean12 FROM c)
SELECT period::VARCHAR AS period, round(diff, 4) AS diff, round((pow(value / l3, 4) - 1) * 100, 4) AS annualised, round((value - l3) / 3, 4) AS mean_step, round(diff - mean12, 3) AS deviation, hi, lo FROM e""")
def momentum_by_unit(spark: SparkSession, d: str) -> DataFrame:
    """Change, three-month momentum as an annualised ratio and as a mean step, deviation from the mean of 12 changes, trailing range."""
    w = Window.orderBy("period")  # one row per month
    c = monthly(spark, d).withColumn("diff", F.col("value") - F.lag("value").over(w)).withColumn("l3", F.lag("value", 3).over(w))
    year = w.rowsBetween(-11, 0)
    c = c.withColumn("mean12", F.avg("diff").over(w.rowsBetween(-12, -1)))
    return c.select(F.col("period").cast("string").alias("period"), F.round("diff", 4).alias("diff"), F.round((F.pow(F.col("value") / F.col("l3"), 4) - 1) * 100, 4).alias("annualised"), F.round((F.col("value") - F.col("l3")) / 3, 4).alias("mean_step"),
                    F.round(F.col("diff") - F.col("mean12"), 3).alias("deviation"), F.max("value").over(year).alias("hi"), F.min("value").over(year).alias("lo"))


@query(f"""WITH {M}, c AS (SELECT period, value - lag(value) OVER (ORDER BY period) AS diff FROM m), d AS (SELECT * FROM c WHERE diff IS NOT NULL)
SELECT a.period::VARCHAR AS period, round(a.diff, 4) AS diff, CASE WHEN count(*) >= 6 THEN floor(100.0::DOUBLE * count(*) FILTER (b.diff <= a.diff) / count(*) + 0.5)::BIGINT END AS pct_rank FROM d a, d b GROUP BY a.period, a.diff""")
def percentile_rank_change(spark: SparkSession, d: str) -> DataFrame:
    """Share of all changes that are at most this one, from one sort (cume_dist)."""
    w = Window.orderBy("period")  # one row per month
    c = monthly(spark, d).withColumn("diff", F.col("value") - F.lag("value").over(w)).where("diff IS NOT NULL")
    n = F.count("*").over(Window.partitionBy())
    return c.select(F.col("period").cast("string").alias("period"), F.round("diff", 4).alias("diff"), F.when(n >= 6, F.floor(F.cume_dist().over(Window.orderBy("diff")) * 100 + 0.5)).cast("long").alias("pct_rank"))


@query(f"""WITH {VIN}, t(moment) AS (VALUES (DATE '1996-01-15'), (DATE '1997-06-30'), (DATE '2000-02-29')) SELECT moment::VARCHAR AS moment, period::VARCHAR AS period, max_by(value, vintage) AS value FROM t JOIN vin ON vintage < moment GROUP BY 1, 2""")
def asof_point_in_time(spark: SparkSession, d: str) -> DataFrame:
    """What each period's value was known to be before some moments."""
    t = spark.createDataFrame([("1996-01-15",), ("1997-06-30",), ("2000-02-29",)], "moment string").select(F.col("moment").cast("date").alias("moment"))
    v = vintages(spark, d).join(F.broadcast(t), F.col("vintage") < F.col("moment"))  # three rows
    return v.groupBy("moment", "period").agg(F.max_by("value", "vintage").alias("value")).select(F.col("moment").cast("string").alias("moment"), F.col("period").cast("string").alias("period"), "value")


@query(f"""WITH {VIN}, c AS (SELECT *, lag(value) OVER w AS pv, lag(vintage) OVER w AS pt FROM vin WINDOW w AS (PARTITION BY period ORDER BY source_rank))
SELECT 'duplicate_value' AS code, 'warn' AS severity, period::VARCHAR AS entity, count(*) AS n FROM c WHERE pv = value GROUP BY period UNION ALL SELECT 'vintage_gap', 'error', period::VARCHAR, count(*) FROM c WHERE date_diff('day', pt, vintage) <> 30 GROUP BY period
UNION ALL SELECT 'large_revision', 'warn', period::VARCHAR, count(*) FROM c WHERE abs(value - pv) > 0.0005::DOUBLE * abs(pv) GROUP BY period UNION ALL SELECT 'look_ahead', 'error', period::VARCHAR, count(*) FROM c WHERE vintage < last_day(period) GROUP BY period""")
def macro_audit_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules over vintages as one pass: each row lists the codes it breaks."""
    w = Window.partitionBy("period").orderBy("source_rank")
    c = vintages(spark, d).withColumn("pv", F.lag("value").over(w)).withColumn("pt", F.lag("vintage").over(w))
    rule = lambda cond, code, sev: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity")))
    codes = F.array_compact(F.array(
        rule(F.col("pv") == F.col("value"), "duplicate_value", "warn"), rule(F.datediff("vintage", "pt") != 30, "vintage_gap", "error"),
        rule(F.abs(F.col("value") - F.col("pv")) > 0.0005 * F.abs("pv"), "large_revision", "warn"), rule(F.col("vintage") < F.last_day("period"), "look_ahead", "error")))
    return c.select("period", F.explode(codes).alias("x")).groupBy("x.code", "x.severity", F.col("period").cast("string").alias("entity")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE, INTERVAL 7 DAY))::DATE AS day FROM orders), x(day, moved) AS (VALUES (DATE '1995-01-15', DATE '1995-01-16'), (DATE '1995-12-31', NULL))
SELECT s.day::VARCHAR AS planned, CASE WHEN x.day IS NULL THEN s.day ELSE x.moved END::VARCHAR AS held FROM s LEFT JOIN x USING (day) WHERE x.day IS NULL OR x.moved IS NOT NULL""")
def weekly_schedule_exceptions(spark: SparkSession, d: str) -> DataFrame:
    """A weekly schedule over the range of orders, with moved and cancelled dates."""
    o = table(spark, d, "orders").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    s = o.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 7 DAYS"))).alias("day"))
    x = spark.createDataFrame([("1995-01-15", "1995-01-16"), ("1995-12-31", None)], "day string, moved string").select(F.col("day").cast("date").alias("day"), F.col("moved").cast("date").alias("moved"), F.lit(True).alias("hit"))
    return s.join(x, "day", "left").where("hit IS NULL OR moved IS NOT NULL").select(F.col("day").cast("string").alias("planned"), F.coalesce("moved", "day").cast("string").alias("held"))


HORIZONS = ["3M", "2 Weeks", "end of 2001", "1998-Q3", "near term", "soon", "3-6 months", "H2 1997", "July", "July 1996", "2001-02", "long_term"]


@query(f"""WITH t AS (SELECT o_orderkey, o_orderdate::DATE AS start, {HORIZONS}[o_orderkey % {len(HORIZONS)} + 1] AS horizon FROM orders), p AS (SELECT *, lower(horizon) AS h, try_cast(nullif(regexp_extract(lower(horizon), '([0-9]{{4}})', 1), '') AS INT) AS y, try_cast(nullif(regexp_extract(lower(horizon), '^([0-9]{{1,3}})', 1), '') AS INT) AS n FROM t),
x AS (SELECT *, CASE WHEN regexp_matches(h, '^end of [0-9]{{4}}$') THEN make_date(y, 12, 31) WHEN regexp_matches(h, '^[0-9]{{4}}-q[1-4]$') THEN last_day(make_date(y, right(h, 1)::INT * 3, 1)) WHEN regexp_matches(h, '^h[12] [0-9]{{4}}$') THEN last_day(make_date(y, substr(h, 2, 1)::INT * 6, 1))
WHEN regexp_matches(h, '^[0-9]{{4}}-[0-9]{{2}}$') THEN last_day(make_date(y, right(h, 2)::INT, 1)) WHEN regexp_matches(h, '^[a-z]+ [0-9]{{4}}$') THEN last_day(strptime('1 ' || h, '%d %B %Y')::DATE)
WHEN h = 'july' THEN CASE WHEN make_date(year(start), 7, 31) > start THEN make_date(year(start), 7, 31) ELSE make_date(year(start) + 1, 7, 31) END END AS named,
CASE WHEN regexp_matches(h, '^[0-9]+m$') THEN n * 30 WHEN regexp_matches(h, '^[0-9]+ weeks$') THEN n * 7 WHEN regexp_matches(h, '^[0-9]+-[0-9]+ months$') THEN (n + regexp_extract(h, '-([0-9]+)', 1)::INT) * 15 WHEN h = 'near term' THEN 30 WHEN h = 'long_term' THEN 365 END AS days FROM p)
SELECT o_orderkey, horizon, CASE WHEN named IS NOT NULL THEN CASE WHEN named > start THEN named END ELSE start + days END::VARCHAR AS due FROM x""")
def horizon_parse(spark: SparkSession, d: str) -> DataFrame:
    texts = F.array(*[F.lit(x) for x in HORIZONS])
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("start"), F.element_at(texts, (F.col("o_orderkey") % len(HORIZONS) + 1).cast("int")).alias("horizon"))
    o = o.withColumn("h", horizon_text(F.col("horizon"))).withColumn("k", horizon_tokens(F.col("h")))
    return o.select("o_orderkey", "horizon", horizon_end(F.col("start"), F.col("h"), F.col("k")).cast("string").alias("due"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) WHEN 2 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS period,
CASE o_orderkey % 4 WHEN 0 THEN date_trunc('year', o_orderdate) WHEN 1 THEN date_trunc('quarter', o_orderdate) WHEN 2 THEN date_trunc('month', o_orderdate) ELSE o_orderdate END::DATE::VARCHAR AS start FROM orders""")
def period_parse(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(day, "yyyy")).when(k == 1, F.concat(F.date_format(day, "yyyy"), F.lit("-Q"), F.quarter(day))).when(k == 2, F.date_format(day, "yyyy-MM")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    o = table(spark, d, "orders").select("o_orderkey", text.alias("period"))
    return o.select("o_orderkey", "period", period_start(F.col("period")).cast("string").alias("start"))


@query("""SELECT event_id, attempt, least(1440, 5 * pow(2, attempt - 1))::BIGINT AS wait FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events WHERE event_type = 'error')""")
def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Minutes to wait after each user's n-th error."""
    e = table(spark, d, "events").where("event_type = 'error'").withColumn("attempt", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    return e.select("event_id", "attempt", backoff_minutes(F.col("attempt")).alias("wait"))


@query(f"""WITH {M}, v AS (SELECT period, value, lag(value) OVER (ORDER BY period) AS prior FROM m), r AS (SELECT period, value, prior, value - prior AS s FROM v)
SELECT period::VARCHAR AS period, count(*) OVER w AS seen, count(*) FILTER (s > 0) OVER w AS beats FROM r WHERE s IS NOT NULL WINDOW w AS (ORDER BY period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def surprise_history_hits(spark: SparkSession, d: str) -> DataFrame:
    """How many of the last four releases beat."""
    w = Window.orderBy("period")  # one row per month
    r = monthly(spark, d).withColumn("s", F.col("value") - F.lag("value").over(w)).where("s IS NOT NULL")
    four = w.rowsBetween(-3, 0)
    return r.select(F.col("period").cast("string").alias("period"), F.count("*").over(four).alias("seen"), F.count_if(F.col("s") > 0).over(four).alias("beats"))


@query("""WITH r AS (SELECT o_orderkey, o_orderdate AS t, o_custkey % 20 AS family FROM orders), e AS (SELECT event_id, ts - INTERVAL '9000' DAY + INTERVAL '1 day' * 0 AS t, user_id % 20 AS family FROM events)
SELECT o_orderkey, event_id FROM r JOIN e ON r.family = e.family AND abs(epoch(r.t) - epoch(e.t)) <= 2700""")
def calendar_tolerance_join(spark: SparkSession, d: str) -> DataFrame:
    """Calendar rows and releases of one family within 45 minutes: buckets of 45 minutes make it an equi join."""
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)
    r = table(spark, d, "orders").select("o_orderkey", sec("o_orderdate").alias("a"), (F.col("o_custkey") % 20).alias("family"))
    e = table(spark, d, "events").select("event_id", (sec("ts") - 9000 * 86400).alias("b"), (F.col("user_id") % 20).alias("family")).withColumn("k", F.floor(F.col("b") / 2700))
    r = r.withColumn("k", F.explode(F.array(*[F.floor(F.col("a") / 2700) + i for i in (-1, 0, 1)])))
    return r.join(e, ["family", "k"]).where(F.abs(F.col("a") - F.col("b")) <= 2700).select("o_orderkey", "event_id")
