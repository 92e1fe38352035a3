"""Release capture and its predicates: targets, polling phases, freshness, licences, expectations and repairs.

Monthly order totals stand for an indicator (see :mod:`macro`), orders for
releases, lines for prints, suppliers for data providers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions.scalar import clamp_confidence, clamped_number, clean_text, half_even, level_from_forecast, period_fits
from lodestream.operators.relational import latest_per_key
from lodestream.plans.base import query
from lodestream.plans.behaviour import events, with_now
from lodestream.plans.macro import M, VIN, monthly, vintages
from lodestream.session import table


def text(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


@query("""WITH r AS (SELECT l_orderkey, CASE WHEN count(*) FILTER (l_linestatus <> 'F') = 0 THEN max(l_shipdate)::DATE END AS released FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(released, o_orderdate::DATE)::VARCHAR AS moment, released IS NOT NULL AS is_out FROM orders LEFT JOIN r ON l_orderkey = o_orderkey
WHERE coalesce(released, o_orderdate::DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'""")
def release_range(spark: SparkSession, d: str) -> DataFrame:
    """Releases whose moment (when released, else when scheduled) lies in a range."""
    out = F.when(F.count_if(F.col("l_linestatus") != "F") == 0, F.to_date(F.max("l_shipdate"))).alias("released")
    released = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(out)
    r = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("scheduled")).join(released, "o_orderkey", "left")
    r = r.withColumn("moment", F.coalesce("released", "scheduled")).where("moment BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'")
    return r.select("o_orderkey", text("moment"), F.col("released").isNotNull().alias("is_out"))


@query("""WITH n AS (SELECT max(ts) AS now FROM events), f AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS failures, max(ts) FILTER (event_type = 'error') AS last FROM events, n WHERE ts >= now - INTERVAL 2 DAY GROUP BY 1),
x AS (SELECT *, last + to_minutes(CAST(least(1440, 5 * power(2, failures - 1)) AS BIGINT)) AS due_at FROM f) SELECT user_id, failures, due_at IS NULL AS untried FROM x, n WHERE failures < 5 AND (due_at IS NULL OR due_at <= now)""")
def backoff_due(spark: SparkSession, d: str) -> DataFrame:
    """Work that may be tried now: fewer failures than the limit, and its waiting time is over or was never set."""
    e = with_now(events(spark, d)).where("ts >= now - INTERVAL 2 DAYS")
    wrong = F.col("event_type") == "error"
    f = e.groupBy("user_id", "now").agg(F.count_if(wrong).alias("failures"), F.max(F.when(wrong, F.col("ts"))).alias("last"))
    wait = F.least(F.lit(1440.0), F.lit(5.0) * F.pow(F.lit(2.0), F.col("failures") - 1)).cast("long")
    f = f.withColumn("due_at", F.timestamp_seconds(F.unix_micros("last") / F.lit(1e6) + wait * 60))
    return f.where("failures < 5 AND (due_at IS NULL OR due_at <= now)").select("user_id", "failures", F.col("due_at").isNull().alias("untried"))


@query("""SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE lower(replace(n_name, '_', '-')) = 'nation-7' OR contains(lower(n_name), 'nation_1')""")
def name_or_slug_resolve(spark: SparkSession, d: str) -> DataFrame:
    """A written name resolved without regard to case against the registry (equal slug, or part of the name), then an exact join."""
    slug, part = " Nation-7 ".strip().lower(), "NATION_1".lower()
    n = table(spark, d, "nation").where((F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))) == slug) | F.contains(F.lower("n_name"), F.lit(part)))
    return table(spark, d, "customer").join(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").select("c_custkey", "n_name")


LICENCES = """lic AS (SELECT s_suppkey, CASE WHEN s_nationkey % 4 = 0 THEN 'PENDING' ELSE 'CONFIRMED' END AS status, CASE WHEN s_suppkey % 9 <> 0 THEN DATE '1996-01-01' END AS confirmed,
CASE WHEN s_suppkey % 3 = 0 THEN DATE '1997-01-01' + (s_suppkey % 700)::INT END AS expires, CASE WHEN s_acctbal > 5000 THEN '["DISPLAY","RESEARCH"]' WHEN s_acctbal > 0 THEN '["DISPLAY"]' ELSE 'none' END AS uses FROM supplier)"""
PERMITS = "status = 'CONFIRMED' AND confirmed IS NOT NULL AND (expires IS NULL OR expires > DATE '1998-01-01') AND list_contains(from_json(CASE WHEN json_valid(uses) THEN uses ELSE '[]' END, '[\"VARCHAR\"]'), '{use}')"


def licences(spark: SparkSession, d: str) -> DataFrame:
    uses = F.when(F.col("s_acctbal") > 5000, '["DISPLAY","RESEARCH"]').when(F.col("s_acctbal") > 0, '["DISPLAY"]').otherwise("none")
    until = F.when(F.col("s_suppkey") % 3 == 0, F.date_add(F.lit("1997-01-01").cast("date"), (F.col("s_suppkey") % 700).cast("int")))
    return table(spark, d, "supplier").select(
        "s_suppkey", F.when(F.col("s_nationkey") % 4 == 0, "PENDING").otherwise("CONFIRMED").alias("status"),
        F.when(F.col("s_suppkey") % 9 != 0, F.lit("1996-01-01").cast("date")).alias("confirmed"), until.alias("expires"), uses.alias("uses"),
    )


def permits(use: str, on: str) -> Column:
    """A confirmed licence, not expired, whose list of uses (JSON text; anything else permits nothing) has the use."""
    listed = F.coalesce(F.array_contains(F.from_json("uses", "array<string>"), use), F.lit(False))
    return (F.col("status") == "CONFIRMED") & F.col("confirmed").isNotNull() & (F.col("expires").isNull() | (F.col("expires") > F.lit(on).cast("date"))) & listed


@query(f"WITH {LICENCES} SELECT s_suppkey, {PERMITS.format(use='RESEARCH')} AS research, {PERMITS.format(use='DISPLAY')} AS display FROM lic")
def licence_permits(spark: SparkSession, d: str) -> DataFrame:
    return licences(spark, d).select("s_suppkey", permits("RESEARCH", "1998-01-01").alias("research"), permits("DISPLAY", "1998-01-01").alias("display"))


@query(f"""WITH {LICENCES}, ok AS (SELECT s_suppkey FROM lic WHERE {PERMITS.format(use='DISPLAY')})
SELECT l_partkey, l_suppkey, max_by(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)) AS price FROM lineitem JOIN ok ON s_suppkey = l_suppkey GROUP BY ALL""")
def licensed_prices(spark: SparkSession, d: str) -> DataFrame:
    """Latest prices of providers whose licence permits display."""
    ok = licences(spark, d).where(permits("DISPLAY", "1998-01-01")).select(F.col("s_suppkey").alias("l_suppkey"))
    lines = table(spark, d, "lineitem").join(ok, "l_suppkey", "left_semi")
    return lines.groupBy("l_partkey", "l_suppkey").agg(F.max_by("l_extendedprice", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("price"))


FRESH = """SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN CASE WHEN closed THEN 345600 ELSE 172800 END WHEN closed THEN greatest(greatest(900, sampling * 3, coalesce(delay, 0) + sampling * 2), 259200) ELSE greatest(900, sampling * 3, coalesce(delay, 0) + sampling * 2) END AS max_age,
(epoch_us(now) - epoch_us(ts)) // 1000000 AS age FROM (SELECT *, (user_id % 3 = 0) AS closed, (user_id % 7) * 600 AS sampling, CASE WHEN event_id % 2 = 0 THEN (event_id % 50) * 60 END AS delay FROM events), n"""


@query(f"WITH n AS (SELECT max(ts) AS now FROM events), f AS ({FRESH}) SELECT event_id, CAST(max_age AS BIGINT) AS max_age, age > max_age AS stale FROM f")
def quote_freshness(spark: SparkSession, d: str) -> DataFrame:
    """How old a quote may be, by its interval and whether its market is open, and whether it is older."""
    e = with_now(events(spark, d))
    closed, sampling = F.col("user_id") % 3 == 0, (F.col("user_id") % 7) * 600
    delay = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 50) * 60)
    active = F.greatest(F.lit(900).cast("long"), sampling * 3, F.coalesce(delay, F.lit(0)) + sampling * 2)
    age = F.floor((F.unix_micros("now") - F.unix_micros("ts")) / 1000000)
    most = F.when(F.col("event_type").isin("view", "click"), F.when(closed, 345600).otherwise(172800)).when(closed, F.greatest(active, F.lit(259200))).otherwise(active)
    return e.select("event_id", most.cast("long").alias("max_age"), (age > most).alias("stale"))


RELEASES = """rel AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'MONTHLY' WHEN 1 THEN 'QUARTERLY' WHEN 2 THEN 'EVENT' ELSE 'EXTERNAL' END AS kind, CASE WHEN o_orderkey % 8 < 4 THEN 1 ELSE 2 END AS lag,
o_orderdate::TIMESTAMP + to_hours((o_custkey % 24)::BIGINT) AS moment, 'REL-' || CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS ext FROM orders)"""


def releases(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    at = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_custkey") % 24 * 3600)
    ext = F.concat(F.lit("REL-"), F.when(k % 5 == 0, "none").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    kind = F.when(k % 4 == 0, "MONTHLY").when(k % 4 == 1, "QUARTERLY").when(k % 4 == 2, "EVENT").otherwise("EXTERNAL")
    return table(spark, d, "orders").select("o_orderkey", kind.alias("kind"), F.when(k % 8 < 4, 1).otherwise(2).alias("lag"), at.alias("at"), ext.alias("ext"))


@query(f"""WITH {RELEASES}, l AS (SELECT *, timezone('America/New_York', timezone('UTC', moment))::DATE AS here FROM rel)
SELECT o_orderkey, (CASE kind WHEN 'MONTHLY' THEN date_trunc('month', here) - to_months(lag) WHEN 'QUARTERLY' THEN date_trunc('quarter', here) - to_months(lag * 3) WHEN 'EVENT' THEN here ELSE try_cast(nullif(regexp_extract(ext, '(\\d{{4}}-\\d{{2}}-\\d{{2}})$', 1), '') AS DATE) END)::DATE::VARCHAR AS target FROM l""")
def release_target_period(spark: SparkSession, d: str) -> DataFrame:
    """The period that a release reports, from its local calendar day and its family's lag, or the date in its external id."""
    r = releases(spark, d).withColumn("here", F.to_date(F.from_utc_timestamp("at", "America/New_York")))
    quarter = F.to_date(F.trunc("here", "quarter"))
    target = (
        F.when(F.col("kind") == "MONTHLY", F.add_months(F.to_date(F.trunc("here", "month")), -F.col("lag")))
        .when(F.col("kind") == "QUARTERLY", F.add_months(quarter, -3 * F.col("lag"))).when(F.col("kind") == "EVENT", F.col("here"))
        .otherwise(F.nullif(F.regexp_extract("ext", r"(\d{4}-\d{2}-\d{2})$", 1), F.lit("")).try_cast("date"))
    )
    return r.select("o_orderkey", target.cast("string").alias("target"))


@query("""WITH n AS (SELECT max(ts) - INTERVAL 1 DAY AS now FROM events), s AS (SELECT event_id, (epoch_us(ts) - epoch_us(now)) / 1e6 AS left_s, CASE WHEN event_type = 'view' THEN 30 ELSE 60 END AS warmup, 10 AS hot, CASE WHEN event_type = 'error' THEN 15 ELSE 60 END AS step FROM events, n)
SELECT event_id, CASE WHEN left_s > warmup * 60 THEN 'outside' WHEN left_s > hot * 60 THEN 'warmup' WHEN left_s > 0 THEN 'hot' WHEN -left_s <= 7200 THEN 'late' ELSE 'expired' END AS phase,
CASE WHEN left_s > warmup * 60 THEN NULL WHEN left_s > hot * 60 THEN 300 WHEN left_s > 0 THEN step WHEN -left_s <= 7200 THEN greatest(30, least(60, step)) END AS every_s FROM s""")
def watch_phase(spark: SparkSession, d: str) -> DataFrame:
    """The polling phase of a release by the seconds left until it, and how often to ask in it."""
    e = with_now(events(spark, d))
    left = (F.unix_micros("ts") - F.unix_micros(F.col("now") - F.expr("INTERVAL 1 DAY"))) / F.lit(1e6)
    warm, step = F.when(F.col("event_type") == "view", 30).otherwise(60) * 60, F.when(F.col("event_type") == "error", 15).otherwise(60)
    phase = F.when(left > warm, "outside").when(left > 600, "warmup").when(left > 0, "hot").when(-left <= 7200, "late").otherwise("expired")
    every = F.when(F.col("phase") == "warmup", 300).when(F.col("phase") == "hot", step).when(F.col("phase") == "late", F.greatest(F.lit(30), F.least(F.lit(60), step)))
    return e.withColumn("phase", phase).select("event_id", "phase", every.alias("every_s"))


PRINTS = f"""{VIN}, pr AS (SELECT v.*, CASE (month(period) + source_rank) % 4 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'PRELIMINARY' ELSE 'PUBLISHED' END AS status, (last_day(period) + 25)::DATE AS scheduled, date_trunc('month', last_day(period) + 25 - INTERVAL 1 MONTH)::DATE AS target,
CASE WHEN month(period) % 2 = 0 THEN vintage - 2 END AS published, lag(value) OVER w AS before, lag(vintage) OVER w AS before_at FROM vin v WINDOW w AS (PARTITION BY period ORDER BY vintage))"""
IS_FRESH = "period = target AND vintage >= scheduled AND status IN ('PUBLISHED', 'PRELIMINARY') AND CASE WHEN published IS NOT NULL THEN published >= scheduled ELSE before IS NULL OR before_at >= scheduled OR value <> before END"


def prints(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("period").orderBy("vintage")
    k = (F.month("period") + F.col("source_rank")) % 4
    return vintages(spark, d).select(
        "*", F.when(k == 0, "DRAFT").when(k == 1, "PRELIMINARY").otherwise("PUBLISHED").alias("status"), F.date_add(F.last_day("period"), 25).alias("scheduled"),
        F.trunc(F.add_months(F.date_add(F.last_day("period"), 25), -1), "month").alias("target"),  # a release is about the month before it
        F.when(F.month("period") % 2 == 0, F.date_sub("vintage", 2)).alias("published"), F.lag("value").over(w).alias("before"), F.lag("vintage").over(w).alias("before_at"),
    )


def is_fresh() -> Column:
    """A print of the period that the release is about (``target``), fetched at or after the schedule, published; by its publication date if known, else it must differ from what was stored before the schedule."""
    known = F.col("published") >= F.col("scheduled")
    new = F.col("before").isNull() | (F.col("before_at") >= F.col("scheduled")) | (F.col("value") != F.col("before"))
    return F.col("period").eqNullSafe(F.col("target")) & (F.col("vintage") >= F.col("scheduled")) & F.col("status").isin("PUBLISHED", "PRELIMINARY") & F.when(F.col("published").isNotNull(), known).otherwise(new)


@query(f"WITH {PRINTS} SELECT period::VARCHAR AS period, source_rank, {IS_FRESH} AS fresh FROM pr")
def fresh_prints(spark: SparkSession, d: str) -> DataFrame:
    return prints(spark, d).select(text("period"), "source_rank", is_fresh().alias("fresh"))


@query(f"""WITH {PRINTS}, have AS (SELECT period FROM m WHERE month(period) = 7), c AS (SELECT * FROM pr WHERE {IS_FRESH} AND period NOT IN (SELECT period FROM have) QUALIFY row_number() OVER (PARTITION BY period ORDER BY source_rank DESC, vintage DESC) = 1),
p AS (SELECT c.*, (SELECT max_by(value, vintage) FROM vin x WHERE x.period = c.period - INTERVAL 1 MONTH AND x.vintage < c.scheduled) AS prior, (SELECT max_by(value, vintage) FROM vin x WHERE x.period = c.period - INTERVAL 1 MONTH AND x.source_rank = c.source_rank) AS told FROM c)
SELECT period::VARCHAR AS period, source_rank, value AS actual, prior, CASE WHEN prior IS NOT NULL AND told <> prior THEN told END AS revised_prior FROM p""")
def capture_once(spark: SparkSession, d: str) -> DataFrame:
    """The first fresh print in order of source priority, for periods not captured before; the prior value as known at the schedule, and its revision only where it differs."""
    have = monthly(spark, d).where(F.month("period") == 7).select("period")
    w = Window.partitionBy("period").orderBy(F.desc("source_rank"), F.desc("vintage"))
    c = prints(spark, d).where(is_fresh()).join(have, "period", "left_anti").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    c = c.select("period", "source_rank", F.col("value").alias("actual"), "scheduled")
    v = vintages(spark, d).select(F.add_months("period", 1).alias("period"), F.col("source_rank").alias("rank"), F.col("value").alias("v"), "vintage")
    known = c.join(v, "period", "left").groupBy(*c.columns).agg(
        F.max_by("v", F.when(F.col("vintage") < F.col("scheduled"), F.col("vintage"))).alias("prior"), F.max_by("v", F.when(F.col("rank") == F.col("source_rank"), F.col("vintage"))).alias("told"),
    )
    return known.select(text("period"), "source_rank", "actual", "prior", F.when(F.col("told") != F.col("prior"), F.col("told")).alias("revised_prior"))


FORECASTS = f"""{M}, f AS (SELECT (period + INTERVAL 1 MONTH)::DATE AS period, k AS kind, value AS previous, CASE k WHEN 0 THEN (month(period) % 9) / 2.0 WHEN 1 THEN (month(period) - 6) * 1000.0 WHEN 2 THEN round(value / 1000) + month(period) * 90 ELSE month(period) / 4.0 - 1.5 END::DOUBLE AS forecast FROM m, range(4) r(k))"""
LEVEL = """CASE kind WHEN 0 THEN forecast WHEN 1 THEN CASE WHEN abs(previous + forecast * 10 - previous) <= abs(previous) * 0.25 THEN previous + forecast * 10 END WHEN 2 THEN CASE WHEN abs(forecast * 1000 - previous) <= abs(previous) * 0.25 THEN forecast * 1000 END ELSE previous * (1 + forecast / 100) END"""


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.month("period"), F.explode(F.sequence(F.lit(0), F.lit(3)))
    f = monthly(spark, d).withColumn("kind", k)
    told = F.when(F.col("kind") == 0, (n % 9) / 2.0).when(F.col("kind") == 1, (n - 6) * 1000.0).when(F.col("kind") == 2, F.round(F.col("value") / 1000) + n * 90).otherwise(n / 4.0 - 1.5)
    return f.select(F.add_months("period", 1).alias("period"), F.col("kind").cast("long").alias("kind"), F.col("value").alias("previous"), told.cast("double").alias("forecast"))


def level() -> Column:
    scale = F.when(F.col("kind") == 1, 10.0).when(F.col("kind") == 2, 1000.0)
    names = F.element_at(F.array(*[F.lit(x) for x in ("level", "delta", "scaled", "relative")]), (F.col("kind") + 1).cast("int"))
    return level_from_forecast(names, F.col("forecast"), F.col("previous"), scale)


@query(f"WITH {FORECASTS} SELECT period::VARCHAR AS period, kind, round({LEVEL}, 2) AS level, ({LEVEL}) IS NULL AS rejected FROM f")
def level_conversion(spark: SparkSession, d: str) -> DataFrame:
    """A forecast of a level, a change, another unit or a percentage as a level; implausible ones are rejected."""
    return forecasts(spark, d).withColumn("level", level()).select(text("period"), "kind", F.round("level", 2).alias("level"), F.col("level").isNull().alias("rejected"))


@query(f"""WITH {FORECASTS}, w AS (SELECT period, value - lag(value) OVER (ORDER BY period) AS width FROM m) SELECT f.period::VARCHAR AS period, round(({LEVEL}) - abs(width), 0) AS lower_level FROM f JOIN w ON w.period = f.period - INTERVAL 1 MONTH WHERE kind = 1 AND ({LEVEL}) IS NOT NULL AND width IS NOT NULL""")
def companion_series(spark: SparkSession, d: str) -> DataFrame:
    """The lower bound that goes with a forecast upper one: it keeps the width in force before the release."""
    m = monthly(spark, d)
    last = m.select(F.add_months("period", 1).alias("period"), F.col("value").alias("lower"))
    width = m.join(last, "period").select(F.add_months("period", 1).alias("period"), F.abs(F.col("value") - F.col("lower")).alias("width"))
    f = forecasts(spark, d).where("kind = 1").withColumn("level", level()).where("level IS NOT NULL").join(width, "period")
    return f.select(text("period"), F.round(F.col("level") - F.col("width"), 0).alias("lower_level"))


@query(f"""WITH {VIN}, l AS (SELECT *, round(value, -4) AS told, lag(round(value, -4)) OVER (PARTITION BY period ORDER BY vintage) AS prev FROM vin) SELECT period::VARCHAR AS period, vintage::VARCHAR AS vintage, told, vintage > (last_day(period) + 25)::DATE AS hindsight FROM l WHERE prev IS NULL OR told <> prev""")
def recaptured(spark: SparkSession, d: str) -> DataFrame:
    """Captures that say something new, each marked if it came after the schedule."""
    w = Window.partitionBy("period").orderBy("vintage")
    v = vintages(spark, d).withColumn("told", F.round("value", -4)).withColumn("prev", F.lag("told").over(w)).where("prev IS NULL OR told <> prev")
    return v.select(text("period"), text("vintage"), "told", (F.col("vintage") > F.date_add(F.last_day("period"), 25)).alias("hindsight"))


@query(f"""WITH {VIN}, cap AS (SELECT period, (last_day(period) + 25)::DATE AS scheduled, CASE WHEN month(period) % 3 <> 0 THEN value END AS previous FROM m), i AS (SELECT period, max_by(source_rank, vintage) AS src FROM vin WHERE month(period) % 5 <> 0 GROUP BY 1),
p AS (SELECT cap.period, (SELECT max_by(value, vintage) FROM vin x WHERE x.period = cap.period - INTERVAL 1 MONTH AND x.vintage < scheduled AND x.source_rank = src) AS own, (SELECT max_by(value, (vintage, source_rank)) FROM vin x WHERE x.period = cap.period - INTERVAL 1 MONTH AND x.vintage < scheduled AND x.source_rank <> src) AS other FROM cap JOIN i USING (period) WHERE previous IS NULL)
SELECT period::VARCHAR AS period, coalesce(own, other) AS previous, own IS NULL AS fell_back FROM p WHERE coalesce(own, other) IS NOT NULL""")
def repaired_previous(spark: SparkSession, d: str) -> DataFrame:
    """Missing previous values filled from what was known before the schedule: the capturing source first, else another."""
    v = vintages(spark, d)
    cap = monthly(spark, d).where(F.month("period") % 3 == 0).select("period", F.date_add(F.last_day("period"), 25).alias("scheduled"))
    first = v.where(F.month("period") % 5 != 0).groupBy("period").agg(F.max_by("source_rank", "vintage").alias("src"))
    old = v.select(F.add_months("period", 1).alias("period"), "source_rank", "value", "vintage")
    j = cap.join(first, "period").join(old, "period").where("vintage < scheduled")
    own = F.col("source_rank") == F.col("src")
    g = j.groupBy("period").agg(F.max_by("value", F.when(own, F.col("vintage"))).alias("own"), F.max_by("value", F.when(~own, F.struct("vintage", "source_rank"))).alias("other"))
    return g.where("own IS NOT NULL OR other IS NOT NULL").select(text("period"), F.coalesce("own", "other").alias("previous"), F.col("own").isNull().alias("fell_back"))


@query("""SELECT event_id, event_type, (user_id % 50)::VARCHAR AS k, CASE WHEN event_type IN ('signup', 'purchase') THEN 'GROWTH' WHEN event_type IN ('click', 'error') THEN upper(event_type) END AS axis FROM events WHERE event_type IN ('signup', 'purchase', 'click', 'error')""")
def axis_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Categories as axes: two fall into one axis, some are their own, others have none and go."""
    kind = F.col("event_type")
    axis = F.when(kind.isin("signup", "purchase"), "GROWTH").when(kind.isin("click", "error"), F.upper(kind))
    return events(spark, d).select("event_id", "event_type", (F.col("user_id") % 50).cast("string").alias("k"), axis.alias("axis")).where("axis IS NOT NULL")


@query("""SELECT o_orderkey, freq, CASE WHEN freq IN ('DAILY', 'WEEKLY', 'EVENT') THEN true WHEN day(p) <> 1 THEN false WHEN freq = 'MONTHLY' THEN true WHEN freq = 'QUARTERLY' THEN (month(p) - 1) % 3 = 0 WHEN freq = 'ANNUAL' THEN month(p) = 1 ELSE false END AS fits
FROM (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN date_trunc('month', o_orderdate) ELSE o_orderdate END AS p, ['DAILY', 'WEEKLY', 'EVENT', 'MONTHLY', 'QUARTERLY', 'ANNUAL', 'OTHER'][o_orderkey % 7 + 1] AS freq FROM orders)""")
def frequency_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Whether a period may stand in a series of its frequency."""
    names = F.array(*[F.lit(x) for x in ("DAILY", "WEEKLY", "EVENT", "MONTHLY", "QUARTERLY", "ANNUAL", "OTHER")])
    p = F.when(F.col("o_custkey") % 2 == 0, F.trunc("o_orderdate", "month")).otherwise(F.to_date("o_orderdate"))
    o = table(spark, d, "orders").select("o_orderkey", F.element_at(names, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("freq"), p.alias("p"))
    return o.select("o_orderkey", "freq", period_fits(F.col("p"), F.col("freq")).alias("fits"))


@query("""SELECT event_id, timezone('Asia/Shanghai', timezone('UTC', ts))::DATE::VARCHAR AS local_day, timezone('UTC', timezone('Asia/Shanghai', date_trunc('day', timezone('Asia/Shanghai', timezone('UTC', ts)))))::VARCHAR AS day_starts,
(date_trunc('week', timezone('Asia/Shanghai', timezone('UTC', ts))) + INTERVAL 6 DAY)::DATE::VARCHAR AS week_ends FROM events""")
def zone_calendar_day(spark: SparkSession, d: str) -> DataFrame:
    """The calendar day of a zone, the UTC moment at which it starts, and the Sunday that ends its week."""
    e = events(spark, d).withColumn("here", F.from_utc_timestamp("ts", "Asia/Shanghai"))
    starts = F.date_format(F.to_utc_timestamp(F.date_trunc("day", "here"), "Asia/Shanghai"), "yyyy-MM-dd HH:mm:ss")
    return e.select("event_id", F.to_date("here").cast("string").alias("local_day"), starts.alias("day_starts"), F.date_add(F.to_date(F.date_trunc("week", "here")), 6).cast("string").alias("week_ends"))


@query("""SELECT l_suppkey, l_returnflag, max(CASE WHEN l_tax = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, l_discount * 12)) END) AS confidence FROM lineitem GROUP BY ALL""")
def max_merged_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The largest confidence said for a key; none said counts as 1, others are kept within 0 and 1."""
    said = clamp_confidence(F.when(F.col("l_tax") != 0, F.col("l_discount") * 12))
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.max(said).alias("confidence"))


@query("""SELECT o_custkey, count(*) AS attempted, count(n_name) AS resolved, count(n_name) / count(*) AS confidence FROM orders LEFT JOIN nation ON n_nationkey = o_orderkey % 40 GROUP BY 1""")
def resolved_over_attempted(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 40).cast("int").alias("n_nationkey")).join(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", "left")
    g = o.groupBy("o_custkey").agg(F.count("*").alias("attempted"), F.count("n_name").alias("resolved"))
    return g.withColumn("confidence", F.when(F.col("attempted") > 0, F.col("resolved") / F.col("attempted")).otherwise(0.0))


@query("""WITH c AS (SELECT l_suppkey, CAST(l_quantity AS BIGINT) - lag(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS c FROM lineitem)
SELECT l_suppkey, count(c) AS changes, round(sqrt(CAST(sum(c * c) * count(c) - sum(c) * sum(c) AS DOUBLE)) / count(c), 6) AS deviation FROM c GROUP BY 1 HAVING count(c) > 0""")
def deviation_of_changes(spark: SparkSession, d: str) -> DataFrame:
    """Population deviation of the changes from one value to the next."""
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    q = half_even(F.col("l_quantity"))
    c = table(spark, d, "lineitem").select("l_suppkey", (q - F.lag(q).over(w)).alias("c"))
    root = F.sqrt((F.sum(F.col("c") * F.col("c")) * F.count("c") - F.sum("c") * F.sum("c")).cast("double"))
    return c.groupBy("l_suppkey").agg(F.count("c").alias("changes"), F.round(root / F.count("c"), 6).alias("deviation")).where("changes > 0")


@query("""WITH n AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 3) SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM n) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30""")
def filtered_then_limited(spark: SparkSession, d: str) -> DataFrame:
    """The newest 30 that pass a filter: the filter comes first, so none is fetched in excess."""
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).count().where("count >= 3")
    o = table(spark, d, "orders").join(n, "o_orderkey", "left_semi").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(30)
    return o.select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))


@query("""SELECT event_id, h % 90 AS jitter_s FROM (SELECT event_id, ('0x' || left(md5(event_id::VARCHAR), 8))::BIGINT AS h FROM events) WHERE h % 1000 < 50""")
def review_sample(spark: SparkSession, d: str) -> DataFrame:
    """One row in twenty by a hash of its id, so that a rerun picks the same ones, each with a delay of up to 90 seconds."""
    h = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("long")
    return events(spark, d).withColumn("h", h).where("h % 1000 < 50").select("event_id", (F.col("h") % 90).alias("jitter_s"))


@query("""WITH a AS (SELECT p_partkey, list_concat(string_split(p_name, ' '), string_split(lower(p_type), ' '), string_split(p_name, ' ')) AS l FROM part) SELECT p_partkey, array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF list_position(l, l[i]) = i], ' ') AS tags FROM a""")
def tag_union(spark: SparkSession, d: str) -> DataFrame:
    """The union of several tag lists, each tag where it came first."""
    name, kind = F.split("p_name", " "), F.split(F.lower("p_type"), " ")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_distinct(F.concat(name, kind, name)), " ").alias("tags"))


@query("""WITH c AS (SELECT l_suppkey % 20 AS family, l_shipdate::DATE AS day, 1 AS priority, l_orderkey AS id FROM lineitem UNION ALL SELECT o_custkey % 20, o_orderdate::DATE, 2, o_orderkey FROM orders)
SELECT family, day::VARCHAR AS day, priority, id FROM c QUALIFY row_number() OVER (PARTITION BY family, day ORDER BY priority, id) = 1""")
def calendar_union(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of several sources, one per family and day, by the precedence of the source."""
    a = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("family"), F.to_date("l_shipdate").alias("day"), F.lit(1).alias("priority"), F.col("l_orderkey").alias("id"))
    b = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("family"), F.to_date("o_orderdate").alias("day"), F.lit(2).alias("priority"), F.col("o_orderkey").alias("id"))
    best = a.union(b).groupBy("family", "day").agg(F.min(F.struct("priority", "id")).alias("b"))
    return best.select("family", text("day"), "b.*")


@query("""WITH asked AS (SELECT DISTINCT o_custkey % 100 AS part, date_trunc('month', o_orderdate)::DATE AS period FROM orders WHERE o_orderpriority = '1-URGENT') SELECT l_partkey AS part, date_trunc('month', l_shipdate)::DATE::VARCHAR AS period, count(*) AS n, max(l_quantity) AS most FROM lineitem WHERE (l_partkey, date_trunc('month', l_shipdate)::DATE) IN (SELECT (part, period) FROM asked) GROUP BY ALL""")
def pair_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Rows of any of many asked (indicator, period) pairs."""
    month = lambda c: F.to_date(F.trunc(F.to_date(c), "month"))
    asked = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select((F.col("o_custkey") % 100).alias("part"), month("o_orderdate").alias("period")).distinct()
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), month("l_shipdate").alias("period"), "l_quantity").join(asked, ["part", "period"], "left_semi")
    return lines.groupBy("part", text("period")).agg(F.count("*").alias("n"), F.max("l_quantity").alias("most"))


@query("""SELECT c_custkey, (SELECT max_by(gid, (length(agent), -gid)) FROM (SELECT n_nationkey AS gid, 'customer#' || repeat('0', 2 + n_nationkey % 7) AS agent FROM nation WHERE n_nationkey % 7 <> 0) WHERE contains(lower(c_name), agent)) AS gid FROM customer""")
def robots_group(spark: SparkSession, d: str) -> DataFrame:
    """The robots group that holds for a user agent: the longest agent token that it contains, the first of several; null means the common group."""
    g = table(spark, d, "nation").where("n_nationkey % 7 <> 0").select(F.col("n_nationkey").alias("gid"), F.concat(F.lit("customer#"), F.repeat(F.lit("0"), 2 + F.col("n_nationkey") % 7)).alias("agent"))
    c = table(spark, d, "customer").select("c_custkey", F.lower("c_name").alias("ua"))
    hit = c.join(F.broadcast(g), F.contains("ua", "agent"), "left")  # one row a group of one file
    return hit.groupBy("c_custkey").agg(F.max_by("gid", F.struct(F.length("agent"), -F.col("gid"))).alias("gid"))


@query("""SELECT conv_id, turn, left(nullif(trim(text), ''), 40) AS label, CASE WHEN turn % 3 = 0 THEN NULL ELSE least(80, greatest(10, CAST(floor(length(text) / 7.0 + 0.5) AS BIGINT))) END AS score, regexp_full_match(left(nullif(trim(replace(role, 's', '-')), ''), 64), '[A-Za-z0-9_-]{8,64}') AS is_view FROM conversations""")
def input_sanitising(spark: SparkSession, d: str) -> DataFrame:
    """Untrusted fields: text trimmed and cut to a budget (null if blank), numbers rounded and kept in range (null if none), ids of a fixed shape."""
    raw = F.when(F.col("turn") % 3 == 0, F.lit("n/a")).otherwise((F.length("text") / 7.0).cast("string"))
    view = clean_text(F.replace("role", F.lit("s"), F.lit("-")), 64).rlike(r"^[A-Za-z0-9_-]{8,64}$")
    return table(spark, d, "conversations").select("conv_id", "turn", clean_text(F.col("text"), 40).alias("label"), clamped_number(raw, 10, 80).alias("score"), view.alias("is_view"))


SORTS = {"oldest": [("c_custkey", True)], "richest": [("c_acctbal", False), ("c_custkey", False)], "segment": [("c_mktsegment", True), ("c_custkey", True)], "newest": [("c_custkey", False)]}


def customers_where(rows: DataFrame, q: str | None = None, segment: str | None = None, status: str | None = None, sort: str | None = None) -> DataFrame:
    """Only filters with a known value narrow; an unknown sort is the default one. ``q`` is part of the name or the segment."""
    if segment in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"):
        rows = rows.where(F.col("c_mktsegment") == segment)
    if status in ("active", "suspended"):
        rows = rows.where(F.col("c_acctbal") >= 0 if status == "active" else F.col("c_acctbal") < 0)
    if q and q.strip():
        rows = rows.where(F.contains("c_name", F.lit(q.strip())) | F.contains("c_mktsegment", F.lit(q.strip())))
    return rows.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in SORTS.get(sort or "", SORTS["newest"])])


@query("""SELECT 1 AS asked, c_custkey FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0 AND (contains(c_name, '1') OR contains(c_mktsegment, '1')) ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 20) UNION ALL SELECT 2, c_custkey FROM (SELECT * FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey DESC LIMIT 20)""")
def optional_filters(spark: SparkSession, d: str) -> DataFrame:
    """Two requests to the filter builder: one with all filters, one whose segment and sort are unknown and so ignored."""
    c = table(spark, d, "customer")
    one = customers_where(c, " 1 ", "BUILDING", "active", "richest").limit(20).select(F.lit(1).alias("asked"), "c_custkey")
    return one.union(customers_where(c, "  ", "NO SUCH", "suspended", "no such").limit(20).select(F.lit(2), "c_custkey"))


@query("""SELECT format('<item><title>{}</title><link>/o/{}</link><date>{}</date></item>', replace(replace(o_orderpriority || ' & ' || o_orderstatus, '&', '&amp;'), '<', '&lt;'), o_orderkey, o_orderdate::DATE) AS item FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""")
def newest_feed_items(spark: SparkSession, d: str) -> DataFrame:
    """The newest 50 as items of an XML feed, marks escaped."""
    o = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50)
    title = F.replace(F.replace(F.concat("o_orderpriority", F.lit(" & "), "o_orderstatus"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return o.select(F.format_string("<item><title>%s</title><link>/o/%d</link><date>%s</date></item>", title, "o_orderkey", F.to_date("o_orderdate").cast("string")).alias("item"))


@query("""SELECT nation, o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM (SELECT c_nationkey AS nation, o_orderkey, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey) QUALIFY row_number() OVER (PARTITION BY nation ORDER BY o_orderdate DESC, o_orderkey DESC) <= 12""")
def candidate_window(spark: SparkSession, d: str) -> DataFrame:
    """The twelve newest candidates of each publisher."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey")
    w = Window.partitionBy("nation").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return o.withColumn("rn", F.row_number().over(w)).where("rn <= 12").select("nation", "o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))


ATTEMPTS = """q AS (SELECT event_id, ts, user_id % 6 AS attempts, CASE event_id % 5 WHEN 0 THEN 'sent' WHEN 1 THEN 'running' ELSE 'pending' END AS state, value > 100 AS reachable FROM events)"""


@query(f"""WITH {ATTEMPTS}, p AS (SELECT * FROM q WHERE state = 'pending' AND attempts < 3 ORDER BY ts, event_id LIMIT 200) SELECT event_id, attempts + 1 AS attempts, CASE WHEN reachable THEN 'sent' WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END AS state FROM p""")
def delivery_batch(spark: SparkSession, d: str) -> DataFrame:
    """The next batch of a delivery queue, oldest first, with the state after one try: sent, failed at the last attempt, else pending again."""
    p = queue(spark, d).where("state = 'pending' AND attempts < 3").orderBy("ts", "event_id").limit(200)
    tried = F.col("attempts") + 1
    return p.select("event_id", tried.alias("attempts"), F.when(F.col("reachable"), "sent").when(tried >= 3, "failed").otherwise("pending").alias("state"))


@query(f"""WITH {ATTEMPTS}, n AS (SELECT max(ts) AS now FROM events) SELECT event_id, CASE WHEN attempts >= 4 THEN 'closed' WHEN state = 'running' AND ts < now - INTERVAL 2 HOUR THEN 'released' WHEN state = 'running' THEN 'running' ELSE 'claimed' END AS became FROM q, n WHERE state <> 'sent'""")
def retry_queue(spark: SparkSession, d: str) -> DataFrame:
    """One pass over a retry queue: too many attempts are closed, runs that went stale are released, others are claimed."""
    q = with_now(queue(spark, d)).where("state <> 'sent'")
    stale = (F.col("state") == "running") & (F.col("ts") < F.col("now") - F.expr("INTERVAL 2 HOURS"))
    return q.select("event_id", F.when(F.col("attempts") >= 4, "closed").when(stale, "released").when(F.col("state") == "running", "running").otherwise("claimed").alias("became"))


def queue(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("event_id") % 5 == 0, "sent").when(F.col("event_id") % 5 == 1, "running").otherwise("pending")
    return events(spark, d).select("event_id", "ts", (F.col("user_id") % 6).alias("attempts"), state.alias("state"), (F.col("value") > 100).alias("reachable"))


ALERTS = """lp AS (SELECT l_partkey, max_by(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS price, max(l_shipdate)::DATE AS day FROM lineitem GROUP BY 1), ru AS (SELECT p_partkey, ['ABOVE', 'BELOW', 'STALE', 'NEAR'][p_partkey % 4 + 1] AS kind, p_retailprice AS bound FROM part)"""


@query(f"""WITH {ALERTS} SELECT p_partkey, kind, price FROM ru JOIN lp ON l_partkey = p_partkey WHERE CASE kind WHEN 'ABOVE' THEN price > bound WHEN 'BELOW' THEN price < bound WHEN 'NEAR' THEN abs(price - bound) <= bound * 0.05 ELSE day < DATE '2000-06-01' END""")
def rule_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Rules of several kinds evaluated over the latest state of what they watch; those that fire."""
    price = F.max_by(F.col("l_extendedprice") / F.col("l_quantity"), F.struct("l_shipdate", "l_orderkey", "l_linenumber"))
    last = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(price.alias("price"), F.to_date(F.max("l_shipdate")).alias("day"))
    kinds = F.array(*[F.lit(x) for x in ("ABOVE", "BELOW", "STALE", "NEAR")])
    rules = table(spark, d, "part").select("p_partkey", F.element_at(kinds, (F.col("p_partkey") % 4 + 1).cast("int")).alias("kind"), F.col("p_retailprice").alias("bound"))
    fires = (
        F.when(F.col("kind") == "ABOVE", F.col("price") > F.col("bound")).when(F.col("kind") == "BELOW", F.col("price") < F.col("bound"))
        .when(F.col("kind") == "NEAR", F.abs(F.col("price") - F.col("bound")) <= F.col("bound") * 0.05).otherwise(F.col("day") < F.lit("2000-06-01").cast("date"))
    )
    return rules.join(last, "p_partkey").where(fires).select("p_partkey", "kind", "price")


@query(f"""WITH {VIN}, u AS (SELECT period, max(vintage) AS last FROM vin WHERE source_rank > 0 GROUP BY 1) SELECT v.period::VARCHAR AS period, v.source_rank, v.value FROM vin v WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.period = v.period AND u.last > v.vintage AND v.source_rank = 1)""")
def correlated_delete(spark: SparkSession, d: str) -> DataFrame:
    """What a delete leaves: rows of one source that a later vintage of the same period supersedes go."""
    v = vintages(spark, d)
    last = v.where("source_rank > 0").groupBy("period").agg(F.max("vintage").alias("last"))
    gone = latest_per_key(v.where("source_rank = 1"), ["period", "source_rank", "vintage"], ["vintage"]).join(last, "period").where("last > vintage").select("period", "source_rank", "vintage")
    return v.join(gone, ["period", "source_rank", "vintage"], "left_anti").select(text("period"), "source_rank", "value")
