"""Consensus, rankings and settlement: views are events (asset = type, institution = user), prices come from line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions.scalar import half_up, wilson
from lodestream.operators.relational import (
    asof_backward, asof_within, changed_only, latest_per_key, ranked_values, top_per_group,
)
from lodestream.plans.base import query
from lodestream.session import table

DIRECTION = "CASE WHEN value >= 100 THEN 2 WHEN value >= 60 THEN 1 WHEN value >= 30 THEN 0 WHEN value >= 10 THEN -1 ELSE -2 END"


def views(spark: SparkSession, d: str) -> DataFrame:
    """Views with direction -2..2 and an authority weight in 0.5..1."""
    return table(spark, d, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("asset"), F.col("user_id").alias("institution"),
        F.expr(DIRECTION).alias("dir"), (F.lit(0.5) + (F.col("user_id") % 50) / F.lit(100.0)).alias("w"), "value",
    )


V = f"v AS (SELECT event_id, ts, event_type AS asset, user_id AS institution, {DIRECTION} AS dir, CAST(0.5 AS DOUBLE) + (user_id % 50) / CAST(100 AS DOUBLE) AS w, value FROM events)"


def score(latest: DataFrame, now: str) -> DataFrame:
    """Weighted, time-decayed consensus per asset from one view per institution; ``now`` is a column."""
    age = (F.unix_micros(now) - F.unix_micros("ts")) / F.lit(86400e6)
    weight = F.col("w") * F.exp(-F.greatest(age, F.lit(0.0)) / 31)
    rows = latest.withColumn("_w", weight)
    total = rows.groupBy("asset").agg(
        F.sum(F.col("_w") * F.col("dir")).alias("num"), F.sum("_w").alias("den"), F.count("*").alias("institutions"),
        F.count_if(F.col("dir") > 0).alias("bull"), F.count_if(F.col("dir") == 0).alias("neutral"), F.count_if(F.col("dir") < 0).alias("bear"),
    )
    raw = F.when(F.col("den") == 0, F.lit(0.0)).otherwise(F.col("num") / F.col("den"))
    return total.select("asset", F.round(raw, 4).alias("raw"), half_up((F.round(raw, 9) + 2) / 4 * 100).alias("score"), "institutions", "bull", "neutral", "bear")


_SCORE = """
agg AS (SELECT asset, sum(w * exp(-greatest(age, 0) / 31) * dir) / sum(w * exp(-greatest(age, 0) / 31)) AS raw, count(*) AS institutions,
  count(*) FILTER (dir > 0) AS bull, count(*) FILTER (dir = 0) AS neutral, count(*) FILTER (dir < 0) AS bear FROM aged GROUP BY asset)
SELECT asset, round(raw, 4) AS raw, CAST(floor((round(raw, 9) + 2) / 4 * 100 + 0.5) AS BIGINT) AS score, institutions, bull, neutral, bear FROM agg"""


@query(f"""WITH {V}, n AS (SELECT max(ts) AS now FROM v),
l AS (SELECT v.*, now FROM v, n WHERE ts >= now - INTERVAL 24 HOUR QUALIFY row_number() OVER (PARTITION BY asset, institution ORDER BY ts DESC, event_id DESC) = 1),
aged AS (SELECT *, (epoch_us(now) - epoch_us(ts)) / 86400e6 AS age FROM l), {_SCORE}""")
def consensus_24h(spark: SparkSession, d: str) -> DataFrame:
    v = views(spark, d)
    recent = v.crossJoin(F.broadcast(v.agg(F.max("ts").alias("now")))).where("ts >= now - INTERVAL 24 HOURS")  # one row
    return score(latest_per_key(recent, ["asset", "institution"], ["ts", "event_id"]), "now")


@query(f"""WITH {V}, n AS (SELECT asset, max(ts) AS now FROM v GROUP BY asset),
l AS (SELECT v.*, now FROM v JOIN n USING (asset) WHERE ts >= now - INTERVAL 24 HOUR QUALIFY row_number() OVER (PARTITION BY asset, institution ORDER BY ts DESC, event_id DESC) = 1),
aged AS (SELECT *, (epoch_us(now) - epoch_us(ts)) / 86400e6 AS age FROM l), {_SCORE}""")
def consensus_fallback_latest_window(spark: SparkSession, d: str) -> DataFrame:
    """The latest day of each asset by itself, for assets without recent views."""
    v = views(spark, d)
    recent = v.join(v.groupBy("asset").agg(F.max("ts").alias("now")), "asset").where("ts >= now - INTERVAL 24 HOURS")
    return score(latest_per_key(recent, ["asset", "institution"], ["ts", "event_id"]), "now")


SNAP = f"snap AS (SELECT asset, CAST(ts AS DATE) AS day, CAST(floor((avg(dir) + 2) / 4 * 100 + 0.5) AS BIGINT) AS score FROM v GROUP BY ALL)"


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    return views(spark, d).groupBy("asset", F.to_date("ts").alias("day")).agg(half_up((F.avg("dir") + 2) / 4 * 100).alias("score"))


@query(f"""WITH {V}, {SNAP}, l AS (SELECT asset, max(day) AS day, max_by(score, day) AS score FROM snap GROUP BY asset)
SELECT l.asset, l.score, l.score - (SELECT max_by(s.score, s.day) FROM snap s WHERE s.asset = l.asset AND s.day <= l.day - 1 AND s.day >= l.day - 32) AS d1,
  l.score - (SELECT max_by(s.score, s.day) FROM snap s WHERE s.asset = l.asset AND s.day <= l.day - 7 AND s.day >= l.day - 32) AS d7,
  l.score - (SELECT max_by(s.score, s.day) FROM snap s WHERE s.asset = l.asset AND s.day <= l.day - 29 AND s.day >= l.day - 32) AS d29 FROM l""")
def consensus_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Change against the last snapshot at least 1, 7 and 29 days old, looking back 32 days at most; one pass."""
    snap = snapshots(spark, d)
    last = snap.groupBy("asset").agg(F.max("day").alias("last"), F.max_by("score", "day").alias("now"))
    age = F.datediff("last", "day")
    rows = snap.join(last, "asset").where(age <= 32)
    old = [F.max_by(F.when(age >= n, F.col("score")), F.when(age >= n, F.col("day"))).alias(f"s{n}") for n in (1, 7, 29)]
    return rows.groupBy("asset", "now").agg(*old).select("asset", F.col("now").alias("score"), *[(F.col("now") - F.col(f"s{n}")).alias(f"d{n}") for n in (1, 7, 29)])


@query(f"""WITH {V}, {SNAP} SELECT asset, strftime(day, '%Y-%m-%d') AS day, score FROM (SELECT *, lag(score) OVER (PARTITION BY asset ORDER BY day) AS b FROM snap) WHERE b IS DISTINCT FROM score OR b IS NULL""")
def snapshot_change_only(spark: SparkSession, d: str) -> DataFrame:
    return changed_only(snapshots(spark, d), ["asset"], "day", "score").select("asset", F.col("day").cast("string").alias("day"), "score")


@query(f"""WITH {V} SELECT asset, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n_views, count(DISTINCT institution) AS institutions FROM v GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT institution) >= 2""")
def coverage_counts_min2(spark: SparkSession, d: str) -> DataFrame:
    g = views(spark, d).groupBy("asset", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n_views"), F.count_distinct("institution").alias("institutions"))
    return g.where("n_views >= 2 AND institutions >= 2")


@query(f"""WITH {V}, n AS (SELECT max(ts) AS now FROM v), w AS (SELECT v.*, now FROM v, n WHERE ts >= now - INTERVAL 7 DAY),
k AS (SELECT asset, (dir > 0)::INT - (dir < 0)::INT AS sgn, count(DISTINCT institution) AS k, round(avg(w), 6) AS a FROM w GROUP BY ALL),
r AS (SELECT event_id, w.asset, least(40, 15 * (k - 1)) + least(10, 2 * (k - 1)) + CASE WHEN abs(dir) = 2 THEN 50 ELSE 0 END AS h, w, (epoch_us(now) - epoch_us(ts)) / 86400e6 AS age
 FROM w JOIN k ON w.asset = k.asset AND (w.dir > 0)::INT - (w.dir < 0)::INT = k.sgn)
SELECT event_id, asset, CAST(least(100, h) AS BIGINT) AS heat, CAST(least(100, h) * 1000000 + floor(w * 100 + 0.5) * 1000 + floor(100 * exp(-age / 3) + 0.5) AS BIGINT) AS ranking
FROM r ORDER BY ranking DESC, event_id LIMIT 50""")
def view_heat_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Heat first, then authority, then freshness, over the last seven days; the 50 hottest."""
    v = views(spark, d)
    w = v.crossJoin(F.broadcast(v.agg(F.max("ts").alias("now")))).where("ts >= now - INTERVAL 7 DAYS").withColumn("sgn", F.signum("dir").cast("int"))
    k = w.groupBy("asset", "sgn").agg(F.count_distinct("institution").alias("k"))
    heat = F.least(F.lit(40), 15 * (F.col("k") - 1)) + F.least(F.lit(10), 2 * (F.col("k") - 1)) + F.when(F.abs("dir") == 2, 50).otherwise(0)
    age = (F.unix_micros("now") - F.unix_micros("ts")) / F.lit(86400e6)
    r = w.join(k, ["asset", "sgn"]).withColumn("heat", F.least(F.lit(100), heat).cast("long"))
    rank = F.col("heat") * 1_000_000 + half_up(F.col("w") * 100) * 1000 + half_up(100 * F.exp(-age / 3))
    return r.select("event_id", "asset", "heat", rank.cast("long").alias("ranking")).orderBy(F.desc("ranking"), "event_id").limit(50)


@query(f"""WITH {V}, c AS (SELECT event_id, asset, dir, max(ts) OVER (PARTITION BY asset, dir) AS newest, count(*) OVER (PARTITION BY asset, dir) AS size FROM v)
SELECT event_id, asset, dir, size, dense_rank() OVER (ORDER BY newest DESC, size DESC, asset, dir) AS place FROM c""")
def cluster_newest_first(spark: SparkSession, d: str) -> DataFrame:
    """Clusters ordered by their newest member, then size; places are ranked over clusters, not rows."""
    v = views(spark, d)
    c = v.groupBy("asset", "dir").agg(F.max("ts").alias("newest"), F.count("*").alias("size"))
    c = c.withColumn("place", F.row_number().over(Window.orderBy(F.desc("newest"), F.desc("size"), "asset", "dir")))  # a row per cluster
    return v.join(c, ["asset", "dir"]).select("event_id", "asset", "dir", "size", F.col("place").cast("long").alias("place"))


@query(f"""WITH {V}, n AS (SELECT max(ts) AS now FROM v), w AS (SELECT v.*, (epoch_us(now) - epoch_us(ts)) / 86400e6 AS age FROM v, n WHERE ts >= now - INTERVAL 14 DAY),
t AS (SELECT asset, count(*) AS n, count(DISTINCT institution) AS inst, avg(dir) AS direction, sum(CASE WHEN age <= 7 THEN 1 ELSE 0 END) AS recent, max(exp(-age / 7)) AS fresh, avg(abs(dir)) AS imp FROM w GROUP BY asset)
SELECT asset, n, inst AS institutions, round(direction, 4) AS direction, CASE WHEN recent * 2 > n * 1.1 THEN 'strengthening' WHEN recent * 2 < n * 0.9 THEN 'fading' ELSE 'steady' END AS status,
  round(least(30, 10 * log2(1 + inst)) + least(20, 5 * log2(1 + n)) + imp / 2 * 20 + fresh * 30, 4) AS score FROM t""")
def theme_scores(spark: SparkSession, d: str) -> DataFrame:
    """Breadth, density, importance and freshness of a theme over 14 days, and whether its last week carries more than its share."""
    v = views(spark, d)
    w = v.crossJoin(F.broadcast(v.agg(F.max("ts").alias("now")))).where("ts >= now - INTERVAL 14 DAYS")
    w = w.withColumn("age", (F.unix_micros("now") - F.unix_micros("ts")) / F.lit(86400e6))
    t = w.groupBy("asset").agg(
        F.count("*").alias("n"), F.count_distinct("institution").alias("institutions"), F.avg("dir").alias("direction"),
        F.count_if(F.col("age") <= 7).alias("recent"), F.max(F.exp(-F.col("age") / 7)).alias("fresh"), F.avg(F.abs("dir")).alias("imp"),
    )
    status = F.when(F.col("recent") * 2 > F.col("n") * 1.1, "strengthening").when(F.col("recent") * 2 < F.col("n") * 0.9, "fading").otherwise("steady")
    points = F.least(F.lit(30.0), 10 * F.log2(1 + F.col("institutions"))) + F.least(F.lit(20.0), 5 * F.log2(1 + F.col("n"))) + F.col("imp") / 2 * 20 + F.col("fresh") * 30
    return t.select("asset", "n", "institutions", F.round("direction", 4).alias("direction"), status.alias("status"), F.round(points, 4).alias("score"))


RANGES = [("launch", "2024-01-03 00:00:00", "2024-01-05 12:00:00", ["click", "view"]), ("sale", "2024-01-05 00:00:00", "2024-01-09 00:00:00", ["purchase"]),
          ("outage", "2024-01-08 06:00:00", "2024-01-08 18:00:00", ["error", "view"]), ("campaign", "2024-01-20 00:00:00", "2024-01-25 00:00:00", ["signup", "click"])]
_RANGE_SQL = ", ".join(f"({k}, '{n}', TIMESTAMP '{a}', TIMESTAMP '{b}', {t})" for k, (n, a, b, t) in enumerate(RANGES))


@query(f"""WITH r(ord, name, lo, hi, types) AS (VALUES {_RANGE_SQL})
SELECT e.event_id, min_by(name, ord) AS name FROM events e JOIN r ON e.ts BETWEEN lo AND hi AND list_contains(types, e.event_type) GROUP BY e.event_id""")
def event_interval_match(spark: SparkSession, d: str) -> DataFrame:
    """The first listed active event whose window holds the row's time and whose types hold its type: days and types make it an equi join."""
    r = spark.createDataFrame([(k, *x) for k, x in enumerate(RANGES)], "ord int, name string, lo string, hi string, types array<string>")
    r = r.select("ord", "name", F.col("lo").cast("timestamp").alias("lo"), F.col("hi").cast("timestamp").alias("hi"), F.explode("types").alias("event_type"))
    r = r.withColumn("day", F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))))
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type").withColumn("day", F.to_date("ts"))
    return e.join(r, ["event_type", "day"]).where("ts BETWEEN lo AND hi").groupBy("event_id").agg(F.min_by("name", "ord").alias("name"))


@query("""WITH v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), e AS (SELECT event_id AS prior_id, user_id, ts FROM events WHERE event_type = 'click')
SELECT v.event_id, e.prior_id FROM v ASOF LEFT JOIN e ON v.user_id = e.user_id AND v.ts >= e.ts""")
def asof_backward_click(spark: SparkSession, d: str) -> DataFrame:
    """Each view with the user's last click at or before it."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    left, right = e.where("event_type = 'view'").drop("event_type"), e.where("event_type = 'click'").withColumn("prior_id", F.col("event_id"))
    return asof_backward(left, right, ["user_id"], "ts", "ts", "prior_id", "event_id", "prior_id").select("event_id", "prior_id")


PRICES = """p AS (SELECT l_partkey % 20 AS asset, CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS price FROM lineitem GROUP BY ALL)"""
TARGETS = PRICES + """, t AS (SELECT asset, date_trunc('month', day)::DATE AS month, min(day) AS day, min_by(price, day) AS price FROM p GROUP BY ALL),
g AS (SELECT t.asset, t.day, t.price AS base, s AS institution, t.price * (1 + (s - 3) / CAST(100 AS DOUBLE)) AS target, s - 3 AS dir, t.day + 30 AS due FROM t, range(7) r(s))"""


def mean_price() -> Column:
    """Mean price by quantity; exact sums, so that every order of rows gives the same number."""
    total = lambda c: F.sum(F.col(c).cast("decimal(18, 2)")).cast("double")
    return total("l_extendedprice") / total("l_quantity")


def prices(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy((F.col("l_partkey") % 20).alias("asset"), F.to_date("l_shipdate").alias("day")).agg(mean_price().alias("price"))


def targets(spark: SparkSession, d: str) -> DataFrame:
    """Seven institutions' targets for each asset and month, due in 30 days."""
    t = prices(spark, d).groupBy("asset", F.trunc("day", "month").alias("month")).agg(F.min("day").alias("day"), F.min_by("price", "day").alias("base"))
    s = F.explode(F.sequence(F.lit(0), F.lit(6)))
    g = t.select("asset", "day", "base", s.alias("institution"))
    return g.select("asset", "day", "base", F.col("institution").cast("long").alias("institution"), (F.col("base") * (1 + (F.col("institution") - 3) / F.lit(100.0))).alias("target"),
                    (F.col("institution") - 3).cast("long").alias("dir"), F.date_add("day", 30).alias("due"))


SETTLED = TARGETS + """, a AS (SELECT g.*, (SELECT min_by(p.price, p.day) FROM p WHERE p.asset = g.asset AND p.day >= g.due AND p.day <= g.due + 7) AS actual FROM g),
s AS (SELECT *, abs(target - actual) AS abs_error, abs(target - actual) / nullif(abs(actual), 0) * 100 AS pct_error, (actual - base) / nullif(base, 0) AS mv FROM a),
settled AS (SELECT *, CASE WHEN actual IS NULL THEN NULL WHEN abs(mv) <= 0.01 THEN dir = 0 ELSE (mv > 0 AND dir > 0) OR (mv < 0 AND dir < 0) END AS correct FROM s)"""


def settled(spark: SparkSession, d: str) -> DataFrame:
    """Targets with the first price within a week of the due day, errors, and whether the direction held (1 % neutral band)."""
    a = asof_within(targets(spark, d), prices(spark, d), ["asset"], "due", "day", 7, True, "price", "actual")
    move = (F.col("actual") - F.col("base")) / F.nullif(F.col("base"), F.lit(0.0))
    error = F.abs(F.col("target") - F.col("actual"))
    right = F.when(F.abs(move) <= 0.01, F.col("dir") == 0).otherwise(((move > 0) & (F.col("dir") > 0)) | ((move < 0) & (F.col("dir") < 0)))
    return a.withColumn("abs_error", error).withColumn("pct_error", error / F.nullif(F.abs("actual"), F.lit(0.0)) * 100).withColumn("correct", F.when(F.col("actual").isNotNull(), right))


@query(f"""WITH {SETTLED} SELECT asset, institution, day::VARCHAR AS day, target, actual, abs_error, pct_error, correct,
CASE WHEN actual IS NULL THEN 'no price in window' END AS reason FROM settled""")
def forecast_settlement(spark: SparkSession, d: str) -> DataFrame:
    r = ["target", "actual", "abs_error", "pct_error"]
    return settled(spark, d).select("asset", "institution", F.col("day").cast("string").alias("day"), *r, "correct", F.when(F.col("actual").isNull(), "no price in window").alias("reason"))


@query(f"""WITH {SETTLED}, k AS (SELECT institution, count(correct) AS n, count(*) FILTER (correct) AS won, avg(pct_error) AS err FROM settled GROUP BY institution)
SELECT institution, n, won, round(err, 4) AS mean_pct_error,
round(greatest(0, (won / n::DOUBLE + 3.8416 / (2 * n) - 1.96 * sqrt(won / n::DOUBLE * (1 - won / n::DOUBLE) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 4) AS lower,
round(least(1, (won / n::DOUBLE + 3.8416 / (2 * n) + 1.96 * sqrt(won / n::DOUBLE * (1 - won / n::DOUBLE) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 4) AS upper FROM k""")
def institution_accuracy_wilson(spark: SparkSession, d: str) -> DataFrame:
    k = settled(spark, d).groupBy("institution").agg(F.count("correct").alias("n"), F.count_if("correct").alias("won"), F.avg("pct_error").alias("err"))
    low, high = wilson(F.col("won"), F.col("n"))
    return k.select("institution", "n", "won", F.round("err", 4).alias("mean_pct_error"), F.round(low, 4).alias("lower"), F.round(high, 4).alias("upper"))


@query(f"""WITH {TARGETS}, l AS (SELECT asset, institution, max_by(target, day) AS target FROM g GROUP BY ALL)
SELECT asset, count(*) AS n, min(target) AS low, max(target) AS high, list_sort(list(target))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median, round(avg(target), 9) AS average FROM l GROUP BY asset HAVING count(*) >= 2""")
def target_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Spread of the institutions' latest targets with the upper median; two institutions at least."""
    last = targets(spark, d).groupBy("asset", "institution").agg(F.max_by("target", "day").alias("target"))
    mid = ranked_values(last, ["asset"], "target", {"median": F.floor(F.col("n") / 2)}).drop("n")
    g = last.groupBy("asset").agg(F.count("*").alias("n"), F.min("target").alias("low"), F.max("target").alias("high"), F.round(F.avg("target"), 9).alias("average"))
    return g.where("n >= 2").join(mid, "asset").select("asset", "n", "low", "high", "median", "average")


@query(f"""WITH {TARGETS} SELECT asset, day::VARCHAR AS day, median(target) AS median, round(avg(target), 9) AS mean, min(target) AS low, max(target) AS high, array_to_string(list(institution ORDER BY target DESC, institution), ',') AS contributors FROM g GROUP BY asset, day""")
def forecast_aggregate_median(spark: SparkSession, d: str) -> DataFrame:
    g = targets(spark, d).groupBy("asset", F.col("day").cast("string").alias("day")).agg(
        F.median("target").alias("median"), F.round(F.avg("target"), 9).alias("mean"), F.min("target").alias("low"), F.max("target").alias("high"),
        F.sort_array(F.collect_list(F.struct((-F.col("target")).alias("t"), "institution"))).alias("c"),
    )  # at most one row per institution and month
    return g.withColumn("contributors", F.concat_ws(",", F.transform("c", lambda x: x["institution"].cast("string")))).drop("c")


@query(f"""WITH {TARGETS}, c AS (SELECT asset, institution, day, floor(target / 50) AS step, lag(floor(target / 50)) OVER (PARTITION BY asset, institution ORDER BY day) AS prev FROM g)
SELECT asset, institution, day::VARCHAR AS day, CAST(step AS BIGINT) AS step, CAST(prev AS BIGINT) AS prev FROM c WHERE prev IS DISTINCT FROM step OR prev IS NULL""")
def target_chain(spark: SparkSession, d: str) -> DataFrame:
    """Targets in steps of 50 with the one before, equal neighbours dropped."""
    g = targets(spark, d).withColumn("step", F.floor(F.col("target") / 50).cast("long"))
    g = g.withColumn("prev", F.lag("step").over(Window.partitionBy("asset", "institution").orderBy("day")))
    return g.where(F.col("prev").isNull() | (F.col("prev") != F.col("step"))).select("asset", "institution", F.col("day").cast("string").alias("day"), "step", "prev")


@query("""WITH q AS (SELECT l_partkey % 20 AS asset, l_suppkey % 3 AS source, CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS price FROM lineitem GROUP BY ALL),
g AS (SELECT asset, source, min(day) AS a, max(day) AS b, min_by(price, day) AS first, max_by(price, day) AS last FROM q GROUP BY ALL)
SELECT asset, source, a::VARCHAR AS first_day, b::VARCHAR AS last_day, round((last - first) / first * 100, 4) AS move_pct FROM g QUALIFY row_number() OVER (PARTITION BY asset ORDER BY b - a DESC, source) = 1""")
def market_moves(spark: SparkSession, d: str) -> DataFrame:
    """Move from the first to the last price of a source; the source with the longest span speaks for the asset."""
    q = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 20).alias("asset"), (F.col("l_suppkey") % 3).alias("source"), F.to_date("l_shipdate").alias("day")).agg(
        mean_price().alias("price"))
    g = q.groupBy("asset", "source").agg(F.min("day").alias("a"), F.max("day").alias("b"), F.min_by("price", "day").alias("first"), F.max_by("price", "day").alias("last"))
    best = top_per_group(g, ["asset"], [F.desc(F.datediff("b", "a")), F.col("source")], 1)
    return best.select("asset", "source", F.col("a").cast("string").alias("first_day"), F.col("b").cast("string").alias("last_day"), F.round((F.col("last") - F.col("first")) / F.col("first") * 100, 4).alias("move_pct"))
