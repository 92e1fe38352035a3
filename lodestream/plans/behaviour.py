"""Behaviour analytics over the click-stream: key figures, breakdowns, funnels, retention, flows, rollups.

A visitor is a user, a path is an event type, a session ends after 30 idle minutes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions.scalar import change, half_up, rate, strict_sum
from lodestream.operators.relational import day_spine, ranked_values, sessions, unpivot_dims
from lodestream.plans.base import query
from lodestream.session import dealt, table


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def with_now(df: DataFrame) -> DataFrame:
    """All rows with the latest time of the table, a single broadcast row."""
    return df.crossJoin(F.broadcast(df.agg(F.max("ts").alias("now"))))


N = "n AS (SELECT max(ts) AS now FROM events)"
S = """o AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1800000000 THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session_no FROM o)"""


@query(f"""WITH {N}, {S}, cur AS (SELECT count(*) AS n_views, count(DISTINCT user_id) AS visitors, count(DISTINCT (user_id, session_no)) AS sess FROM s, n WHERE ts >= now - INTERVAL 7 DAY),
b AS (SELECT count(*) AS bounces FROM (SELECT user_id, session_no FROM s, n WHERE ts >= now - INTERVAL 7 DAY GROUP BY ALL HAVING count(*) = 1)),
p AS (SELECT count(*) FILTER (ts < now - INTERVAL 7 DAY) AS pv, count(DISTINCT user_id) AS pu FROM events, n WHERE ts >= now - INTERVAL 14 DAY AND ts <= now - INTERVAL 7 DAY)
SELECT n_views, visitors, sess AS sessions, CASE WHEN sess > 0 THEN round(bounces * 100.0::DOUBLE / sess, 1) END AS bounce_pct, CASE WHEN pv > 0 THEN round((n_views - pv) * 100.0::DOUBLE / pv, 1) END AS views_change, CASE WHEN pu > 0 THEN round((visitors - pu) * 100.0::DOUBLE / pu, 1) END AS visitors_change FROM cur, b, p""")
def overview_kpis(spark: SparkSession, d: str) -> DataFrame:
    """Views, visitors, sessions, bounces of seven days and the change against the seven before; both windows share their edge for visitors."""
    s = with_now(sessions(events(spark, d), "user_id", "ts", "event_id"))
    edge, start = F.expr("now - INTERVAL 7 DAYS"), F.expr("now - INTERVAL 14 DAYS")
    now, before = F.col("ts") >= edge, (F.col("ts") >= start) & (F.col("ts") <= edge)
    per = s.where(F.col("ts") >= start).groupBy("user_id", "session_no").agg(
        F.count_if(now).alias("v"), F.count_if(before & (F.col("ts") < edge)).alias("pv"), F.max(before.cast("int")).alias("was"))
    g = per.agg(
        F.sum("v").alias("n_views"), F.count_distinct(F.when(F.col("v") > 0, F.col("user_id"))).alias("visitors"), F.count_if(F.col("v") > 0).alias("sessions"),
        F.count_if(F.col("v") == 1).alias("bounces"), F.sum("pv").alias("pv"), F.count_distinct(F.when(F.col("was") == 1, F.col("user_id"))).alias("pu"))
    return g.select("n_views", "visitors", "sessions", rate(F.col("bounces"), F.col("sessions")).alias("bounce_pct"),
                    change(F.col("n_views"), F.col("pv")).alias("views_change"), change(F.col("visitors"), F.col("pu")).alias("visitors_change"))


@query("SELECT event_type AS label, count(*) AS n_views, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1 ORDER BY n_views DESC, label LIMIT 10")
def breakdown_dimension(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d).groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n_views"), F.count_distinct("user_id").alias("visitors"))
    return g.orderBy(F.desc("n_views"), "label").limit(10)


@query("SELECT event_type AS name, count(*) AS n, count(DISTINCT user_id) AS visitors, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, max(ts)::DATE::VARCHAR AS last_day FROM events GROUP BY 1")
def events_table(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy(F.col("event_type").alias("name")).agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("visitors"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 4).alias("mean"),
        F.to_date(F.max("ts")).cast("string").alias("last_day"))


@query(f"""WITH {N}, h AS (SELECT date_trunc('hour', now) - to_hours(k::INT) AS hour FROM n, range(24) r(k)),
c AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n, count(DISTINCT user_id) AS u FROM events GROUP BY 1)
SELECT strftime(hour, '%Y-%m-%d %H') AS hour, coalesce(n, 0) AS n_views, coalesce(u, 0) AS visitors FROM h LEFT JOIN c USING (hour)""")
def timeseries_hour(spark: SparkSession, d: str) -> DataFrame:
    """The last 24 hours in buckets, empty ones with zeros."""
    e = with_now(events(spark, d))
    recent = e.where(F.col("ts") >= F.date_trunc("hour", "now") - F.expr("INTERVAL 23 HOURS"))
    c = recent.groupBy(F.window("ts", "1 hour")["start"].alias("hour")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("u"))
    last = e.agg(F.date_trunc("hour", F.max("now")).alias("h"))
    spine = last.select(F.explode(F.sequence(F.expr("h - INTERVAL 23 HOURS"), "h", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    return spine.join(c, "hour", "left").select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), F.coalesce("n", F.lit(0)).alias("n_views"), F.coalesce("u", F.lit(0)).alias("visitors"))


@query("""WITH c AS (SELECT ts::DATE AS day, count(*) AS n, count(DISTINCT user_id) AS u FROM events WHERE event_type = 'signup' GROUP BY 1),
s AS (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY))::DATE AS day FROM events) SELECT day::VARCHAR AS day, coalesce(n, 0) AS signups, coalesce(u, 0) AS users FROM s LEFT JOIN c USING (day)""")
def timeseries_day(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("day", F.to_date("ts"))
    c = e.where("event_type = 'signup'").groupBy("day").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("u"))
    return day_spine(e, "day").join(c, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("signups"), F.coalesce("u", F.lit(0)).alias("users"))


@query(f"WITH {N} SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS active FROM events, n WHERE ts >= now - INTERVAL 30 MINUTE GROUP BY 1")
def realtime_30m(spark: SparkSession, d: str) -> DataFrame:
    return with_now(events(spark, d)).where("ts >= now - INTERVAL 30 MINUTES").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("active"))


@query(f"""WITH {N} SELECT count(DISTINCT user_id) FILTER (ts >= now - INTERVAL 1 DAY) AS dau, count(DISTINCT user_id) FILTER (ts >= now - INTERVAL 7 DAY) AS wau, count(DISTINCT user_id) FILTER (ts >= now - INTERVAL 30 DAY) AS mau,
round(count(DISTINCT user_id) FILTER (ts >= now - INTERVAL 1 DAY) * 100.0::DOUBLE / count(DISTINCT user_id) FILTER (ts >= now - INTERVAL 30 DAY), 1) AS stickiness FROM events, n""")
def audience_dau_wau_mau(spark: SparkSession, d: str) -> DataFrame:
    last = with_now(events(spark, d)).groupBy("user_id").agg(F.max("ts").alias("ts"), F.max("now").alias("now"))
    g = last.agg(*[F.count_if(F.expr(f"ts >= now - INTERVAL {n} DAYS")).alias(a) for a, n in (("dau", 1), ("wau", 7), ("mau", 30))])
    return g.select("*", rate(F.col("dau"), F.col("mau")).alias("stickiness"))


@query("""WITH u AS (SELECT user_id, bool_or(event_type = 'signup') AS s, bool_or(event_type = 'click') AS c, bool_or(event_type = 'purchase') AS p FROM events GROUP BY 1)
SELECT step, n FROM (SELECT 1 AS step, count(*) AS n FROM u UNION ALL SELECT 2, count(*) FILTER (s) FROM u UNION ALL SELECT 3, count(*) FILTER (s AND c) FROM u UNION ALL SELECT 4, count(*) FILTER (s AND c AND p) FROM u)""")
def funnel(spark: SparkSession, d: str) -> DataFrame:
    """Visitors, of them signed up, of those clicked, of those bought."""
    u = events(spark, d).groupBy("user_id").agg(*[F.bool_or(F.col("event_type") == t).alias(t) for t in ("signup", "click", "purchase")])
    g = u.agg(F.count("*").alias("a"), F.count_if("signup").alias("b"), F.count_if(F.expr("signup AND click")).alias("c"), F.count_if(F.expr("signup AND click AND purchase")).alias("d"))
    return g.select(F.expr("stack(4, 1, a, 2, b, 3, c, 4, d) AS (step, n)"))


@query("""WITH f AS (SELECT user_id, min(ts)::DATE AS day0 FROM events WHERE event_type = 'signup' GROUP BY 1), m AS (SELECT max(ts)::DATE AS last FROM events),
a AS (SELECT DISTINCT f.user_id, date_diff('day', DATE '2024-01-01', day0) // 7 AS cohort, date_diff('day', day0, ts::DATE) // 7 AS week FROM f JOIN events USING (user_id) WHERE ts::DATE >= day0),
z AS (SELECT date_diff('day', DATE '2024-01-01', day0) // 7 AS cohort, count(*) AS size FROM f GROUP BY 1)
SELECT cohort, week, size, count(*) AS active, round(count(*) * 100.0::DOUBLE / size, 1) AS pct FROM a JOIN z USING (cohort), m WHERE cohort * 7 + week * 7 <= date_diff('day', DATE '2024-01-01', last) GROUP BY cohort, week, size""")
def retention_weekly(spark: SparkSession, d: str) -> DataFrame:
    """Weekly cohorts by first sign-up and how many of them came back in each later week that the data reaches."""
    e = events(spark, d).withColumn("day", F.to_date("ts"))
    first = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("day").alias("day0"))
    last = F.broadcast(e.agg(F.max("day").alias("last")))
    week = lambda a, b: F.floor(F.datediff(b, a) / 7).cast("long")
    origin = F.lit("2024-01-01").cast("date")
    size = first.groupBy(week(origin, "day0").alias("cohort")).agg(F.count("*").alias("size"))
    active = e.select("user_id", "day").distinct().join(first, "user_id").where("day >= day0").select("user_id", week(origin, "day0").alias("cohort"), week("day0", "day").alias("week")).distinct()
    g = active.groupBy("cohort", "week").agg(F.count("*").alias("active")).join(size, "cohort").crossJoin(last).where((F.col("cohort") + F.col("week")) * 7 <= F.datediff("last", origin))
    return g.select("cohort", "week", "size", "active", rate(F.col("active"), F.col("size")).alias("pct"))


@query("SELECT user_id, c_name AS name, n, days FROM (SELECT user_id, count(*) AS n, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1) JOIN customer ON c_custkey = user_id ORDER BY n DESC, user_id LIMIT 20")
def top_users(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("days"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return g.join(c, "user_id").select("user_id", "name", "n", "days").orderBy(F.desc("n"), "user_id").limit(20)


@query(f"""WITH {S}, v AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id) AS nxt FROM s),
m AS (SELECT event_type, list_sort(list(value)) AS l FROM v GROUP BY 1)
SELECT event_type AS path, count(*) AS n_views, count(*) FILTER (nxt IS NULL) AS exits, round(count(*) FILTER (value >= 30) * 100.0::DOUBLE / count(*), 1) AS read_pct, round(count(*) FILTER (value < 3) * 100.0::DOUBLE / count(*), 1) AS glance_pct,
any_value(CASE WHEN len(l) % 2 = 1 THEN l[len(l) // 2 + 1] ELSE floor((l[len(l) // 2] + l[len(l) // 2 + 1]) / 2 + 0.5) END) AS median FROM v JOIN m USING (event_type) GROUP BY 1""")
def page_performance(spark: SparkSession, d: str) -> DataFrame:
    """Views, exits, read and glance shares, and the median (rounded where it lies between two values)."""
    s = sessions(events(spark, d), "user_id", "ts", "event_id")
    v = s.withColumn("nxt", F.lead("event_type").over(Window.partitionBy("user_id", "session_no").orderBy("ts", "event_id")))
    g = v.groupBy(F.col("event_type").alias("path")).agg(F.count("*").alias("n_views"), F.count_if(F.col("nxt").isNull()).alias("exits"), F.count_if(F.col("value") >= 30).alias("r"), F.count_if(F.col("value") < 3).alias("q"))
    mid = ranked_values(v.withColumnRenamed("event_type", "path"), ["path"], "value", {"a": F.floor((F.col("n") - 1) / 2), "b": F.floor(F.col("n") / 2)})
    median = F.when(F.col("n") % 2 == 1, F.col("a")).otherwise(half_up((F.col("a") + F.col("b")) / 2).cast("double"))
    return g.join(mid, "path").select("path", "n_views", "exits", rate(F.col("r"), F.col("n_views")).alias("read_pct"), rate(F.col("q"), F.col("n_views")).alias("glance_pct"), median.alias("median"))


@query("""WITH c AS (SELECT least(9, greatest(0, floor(value / 10)))::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1)
SELECT b AS bin, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0::DOUBLE / (SELECT count(*) FROM events), 2) AS share FROM range(10) r(b) LEFT JOIN c ON c.bin = r.b""")
def histogram10(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    c = e.groupBy(F.least(F.lit(9), F.greatest(F.lit(0), F.floor(F.col("value") / 10))).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    total = F.broadcast(c.agg(F.sum("n").alias("total")))
    rows = spark.range(10).withColumnRenamed("id", "bin").join(c, "bin", "left").crossJoin(total)
    return rows.select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) * F.lit(100.0) / F.col("total"), 2).alias("share"))


@query("""WITH m AS (SELECT event_type, list_sort(list(value)) AS l FROM events GROUP BY 1) SELECT event_type AS metric, len(l)::BIGINT AS n, l[least(len(l) - 1, floor(len(l) * 0.75)::BIGINT) + 1] AS p75,
CASE WHEN p75 <= 50 THEN 'good' WHEN p75 <= 60 THEN 'fair' ELSE 'poor' END AS rating FROM m""")
def vitals_index_p75(spark: SparkSession, d: str) -> DataFrame:
    """The value at index floor(0.75 n) of the sorted list, and its band."""
    place = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.75))
    g = ranked_values(events(spark, d).withColumnRenamed("event_type", "metric"), ["metric"], "value", {"p75": place})
    return g.select("metric", "n", "p75", F.when(F.col("p75") <= 50, "good").when(F.col("p75") <= 60, "fair").otherwise("poor").alias("rating"))


@query(f"""WITH {S}, v AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id) AS dst FROM s) SELECT src, dst, count(*) AS n FROM v WHERE dst IS NOT NULL GROUP BY 1, 2""")
def page_flow(spark: SparkSession, d: str) -> DataFrame:
    s = sessions(events(spark, d), "user_id", "ts", "event_id")
    v = s.select(F.col("event_type").alias("src"), F.lead("event_type").over(Window.partitionBy("user_id", "session_no").orderBy("ts", "event_id")).alias("dst"))
    return v.where("dst IS NOT NULL").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT user_id, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1 HAVING count(DISTINCT ts::DATE) >= 20) SELECT user_id, days, count(*) AS n, max(ts)::DATE::VARCHAR AS last_day FROM events JOIN l USING (user_id) GROUP BY user_id, days""")
def loyal_users(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d).groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("days"), F.count("*").alias("n"), F.to_date(F.max("ts")).cast("string").alias("last_day"))
    return g.where("days >= 20")


@query("""SELECT ts::DATE::VARCHAR AS day, count(*) FILTER (user_id % 10 < 2) AS crawler, count(*) FILTER (user_id % 10 = 2) AS monitor, count(*) FILTER (user_id % 10 > 2) AS human FROM events GROUP BY 1""")
def bot_daily_pivot(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("user_id") % 10 < 2, "crawler").when(F.col("user_id") % 10 == 2, "monitor").otherwise("human")
    p = events(spark, d).select(F.to_date("ts").cast("string").alias("day"), kind.alias("kind")).groupBy("day").pivot("kind", ["crawler", "monitor", "human"]).count()
    return p.fillna(0)


ROLL = f"""{S}, r AS (SELECT ts::DATE::VARCHAR AS day, user_id, session_no, value, unnest([{{'dimension': 'total', 'value': ''}}, {{'dimension': 'event_type', 'value': event_type}}, {{'dimension': 'band', 'value': CASE WHEN value >= 50 THEN 'high' ELSE 'low' END}}]) AS dv FROM s),
b AS (SELECT day, 'total' AS dimension, count(*) AS bounces FROM (SELECT ts::DATE::VARCHAR AS day, user_id, session_no FROM s GROUP BY ALL HAVING count(*) = 1) GROUP BY 1)"""


def rollup_rows(e: DataFrame) -> DataFrame:
    """Day by dimension and value: views, visitors, sessions, seconds; bounces on the total only."""
    s = sessions(dealt(e, e, "user_id"), "user_id", "ts", "event_id").withColumn("day", F.to_date("ts").cast("string")).withColumn("band", F.when(F.col("value") >= 50, "high").otherwise("low"))
    s = s.withColumnRenamed("value", "seconds")
    flat = unpivot_dims(s, ["event_type", "band"], ["day", "user_id", "session_no", "seconds"])
    per = flat.groupBy("day", "dimension", "value", "user_id", "session_no").agg(F.count("*").alias("n"), F.sum("seconds").alias("sec"))
    return per.groupBy("day", "dimension", "value").agg(
        F.sum("n").alias("n_views"), F.count_distinct("user_id").alias("visitors"), F.count("*").alias("sessions"), F.round(F.sum("sec"), 4).alias("seconds"),
        F.when(F.col("dimension") == "total", F.count_if(F.col("n") == 1)).alias("bounces"))


@query(f"""WITH {ROLL}, g AS (SELECT day, dv.dimension AS dimension, dv.value AS dvalue, count(*) AS n_views, count(DISTINCT user_id) AS visitors, count(DISTINCT (user_id, session_no)) AS sessions, round(sum(value), 4) AS seconds FROM r GROUP BY ALL)
SELECT g.day, g.dimension, g.dvalue AS value, n_views, visitors, sessions, seconds, CASE WHEN g.dimension = 'total' THEN coalesce(bounces, 0) END AS bounces FROM g LEFT JOIN b ON g.day = b.day AND g.dimension = b.dimension""")
def rollup_daily_dims(spark: SparkSession, d: str) -> DataFrame:
    return rollup_rows(events(spark, d))


@query("""SELECT CASE WHEN grouping(role) = 0 THEN 'role' WHEN grouping(turn) = 0 THEN 'turn' ELSE 'total' END AS slice, coalesce(role, CAST(turn AS VARCHAR), '') AS label, count(*) AS calls, sum(length(text))::BIGINT AS chars,
CASE WHEN count(*) FILTER (turn > 6) = 0 THEN sum(turn)::BIGINT END AS cost FROM conversations GROUP BY GROUPING SETS ((), (role), (turn))""")
def usage_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Calls, characters and a cost that is null as soon as one call has no price (turns over 6), in total, by role and by turn."""
    c = table(spark, d, "conversations").select("role", "turn", F.length("text").cast("long").alias("chars"), F.when(F.col("turn") <= 6, F.col("turn")).alias("price"))
    g = c.groupingSets([[], [F.col("role")], [F.col("turn")]], F.col("role"), F.col("turn")).agg(
        F.grouping("role").alias("gr"), F.grouping("turn").alias("gt"), F.count("*").alias("calls"), F.sum("chars").alias("chars"), strict_sum(F.col("price")).alias("cost"))
    slice_ = F.when(F.col("gr") == 0, "role").when(F.col("gt") == 0, "turn").otherwise("total")
    return g.select(slice_.alias("slice"), F.coalesce("role", F.col("turn").cast("string"), F.lit("")).alias("label"), "calls", "chars", "cost")


@query("""WITH s AS (SELECT coalesce(role, '*') AS scope, sum(length(text))::BIGINT AS spent FROM conversations GROUP BY ROLLUP (role)), b(scope, ceiling) AS (VALUES ('*', 200000), ('user', 40000), ('assistant', 1000000), ('tool', 5000))
SELECT b.scope, ceiling::BIGINT AS ceiling, coalesce(spent, 0) AS spent, CASE WHEN coalesce(spent, 0) >= ceiling THEN 'over' WHEN coalesce(spent, 0) >= ceiling * 0.8 THEN 'near' ELSE 'within' END AS verdict FROM b LEFT JOIN s USING (scope)""")
def budget_verdict(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "conversations").rollup("role").agg(F.sum(F.length("text")).alias("spent")).select(F.coalesce("role", F.lit("*")).alias("scope"), "spent")
    b = spark.createDataFrame([("*", 200000), ("user", 40000), ("assistant", 1000000), ("tool", 5000)], "scope string, ceiling long")
    spent = F.coalesce("spent", F.lit(0)).cast("long")
    return b.join(s, "scope", "left").select("scope", "ceiling", spent.alias("spent"), F.when(spent >= F.col("ceiling"), "over").when(spent >= F.col("ceiling") * 0.8, "near").otherwise("within").alias("verdict"))


@query("""SELECT event_type AS endpoint, count(*) AS calls, round(sum(value) / count(*), 4) AS mean_ms, round(count(*) FILTER (value > 90) * 100.0::DOUBLE / count(*), 2) AS slow_pct FROM events GROUP BY 1""")
def weighted_latency(spark: SparkSession, d: str) -> DataFrame:
    """Mean latency from daily counters (total over calls), not a mean of means."""
    day = events(spark, d).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"), F.sum("value").alias("total"), F.count_if(F.col("value") > 90).alias("slow"))
    g = day.groupBy(F.col("event_type").alias("endpoint")).agg(F.sum("calls").alias("calls"), F.sum("total").alias("total"), F.sum("slow").alias("slow"))
    return g.select("endpoint", "calls", F.round(F.col("total") / F.col("calls"), 4).alias("mean_ms"), rate(F.col("slow"), F.col("calls"), 2).alias("slow_pct"))


@query(f"WITH {S} SELECT user_id, session_no, count(*) AS n, min(event_id) AS first_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS micros FROM s GROUP BY 1, 2")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    s = sessions(events(spark, d), "user_id", "ts", "event_id")
    return s.groupBy("user_id", "session_no").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("micros"))


@query(f"""WITH {N}, d AS (SELECT user_id, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1) SELECT count(*) AS users, sum(CASE WHEN days >= 15 THEN 1 ELSE 0 END)::BIGINT AS steady, max(days) AS most, min(days) AS least_days, round(avg(days), 4) AS mean_days FROM d""")
def behaviour_overview(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d).groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("days"))
    return g.agg(F.count("*").alias("users"), F.count_if(F.col("days") >= 15).alias("steady"), F.max("days").alias("most"), F.min("days").alias("least_days"), F.round(F.avg("days"), 4).alias("mean_days"))


@query("""SELECT event_id, user_id, CASE WHEN n > 20 THEN 'limited' ELSE 'ok' END AS verdict FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS n FROM events)""")
def rate_limit_fixed_window(spark: SparkSession, d: str) -> DataFrame:
    """Requests over 20 a user and day are limited."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return events(spark, d).select("event_id", "user_id", F.when(F.row_number().over(w) > 20, "limited").otherwise("ok").alias("verdict"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - row_number() OVER (PARTITION BY event_type, value > 50 ORDER BY ts, event_id) AS grp FROM events)
SELECT event_type AS source, max(c) AS longest, count(*) AS streaks FROM (SELECT event_type, grp, count(*) AS c FROM r WHERE value > 50 GROUP BY 1, 2) GROUP BY 1""")
def failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive failures (value over 50) per source: their number and the longest.

    Runs are found inside each source's days, a task a day; only those that touch an edge of their day, two a day at
    most, are put in order and joined with the next day's.
    """
    key = ["event_type", "day"]
    e = events(spark, d).select("event_type", F.to_date("ts").alias("day"), "ts", "event_id", (F.col("value") > 50).alias("bad")).where("bad IS NOT NULL")
    w = Window.partitionBy(*key).orderBy("ts", "event_id")
    r = e.withColumn("rn", F.row_number().over(w)).withColumn("size", F.count("*").over(Window.partitionBy(*key)))
    r = r.withColumn("grp", F.col("rn") - F.row_number().over(Window.partitionBy(*key, "bad").orderBy("ts", "event_id")))
    runs = r.where("bad").groupBy(*key, "grp").agg(F.count("*").alias("c"), (F.min("rn") == 1).alias("opens"), (F.max("rn") == F.max("size")).alias("ends"), F.min("rn").alias("first"))
    days = r.select(*key).distinct().withColumn("day_no", F.row_number().over(Window.partitionBy("event_type").orderBy("day")))
    by = Window.partitionBy("event_type").orderBy("day_no", "first")
    edge = runs.where("opens OR ends").join(days, key)
    goes_on = F.col("opens") & (F.lag("day_no").over(by) == F.col("day_no") - 1) & F.lag("ends").over(by)
    edge = edge.withColumn("run", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(by))
    whole = edge.groupBy("event_type", "run").agg(F.sum("c").alias("c")).select("event_type", "c").union(runs.where("NOT opens AND NOT ends").select("event_type", "c"))
    return whole.groupBy(F.col("event_type").alias("source")).agg(F.max("c").alias("longest"), F.count("*").alias("streaks"))


@query("""WITH h AS (SELECT event_id, user_id, event_type, ts FROM events WHERE value > 80), f AS (SELECT *, lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS p FROM h)
SELECT event_type AS rule, user_id AS target, event_id FROM f WHERE p IS NULL""")
def alert_dedupe_forever(spark: SparkSession, d: str) -> DataFrame:
    """The first alert of each rule and target; later ones stay silent."""
    h = events(spark, d).where("value > 80")
    return h.groupBy(F.col("event_type").alias("rule"), F.col("user_id").alias("target")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
