"""Release signals, reports and checks: expectations, fallbacks, budgets, agreement, summaries, path and text checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions.scalar import rate
from lodestream.operators.relational import top_per_group
from lodestream.operators.text import sentences
from lodestream.plans.base import query
from lodestream.plans.behaviour import events
from lodestream.plans.macro import M, VIN, monthly, vintages
from lodestream.session import table


@query(f"""WITH {M}, e AS (SELECT (period + INTERVAL 1 MONTH)::DATE AS period, value AS expected, k, ((period + INTERVAL 1 MONTH)::DATE + 20 - (k * 7 - 6)::INT)::DATE AS captured FROM m, range(3) r(k)),
s AS (SELECT period, (period + 14)::DATE AS scheduled FROM m) SELECT s.period::VARCHAR AS period, max_by(expected, captured) AS expected, max(captured)::VARCHAR AS captured FROM s JOIN e USING (period) WHERE captured <= scheduled GROUP BY 1""")
def expectation_point_in_time(spark: SparkSession, d: str) -> DataFrame:
    """The latest expectation captured no later than the schedule; later captures are hindsight."""
    m = monthly(spark, d)
    k = F.explode(F.sequence(F.lit(0), F.lit(2)))
    e = m.select(F.add_months("period", 1).alias("period"), F.col("value").alias("expected"), k.alias("k"))
    e = e.withColumn("captured", F.date_add("period", 20 - (F.col("k") * 7 - 6)))
    s = m.select("period", F.date_add("period", 14).alias("scheduled"))
    g = s.join(e, "period").where("captured <= scheduled").groupBy("period").agg(F.max_by("expected", "captured").alias("expected"), F.max("captured").cast("string").alias("captured"))
    return g.select(F.col("period").cast("string").alias("period"), "expected", "captured")


@query(f"""WITH {VIN}, own AS (SELECT period, max_by(value, vintage) AS v FROM vin WHERE source_rank = 1 AND month(period) % 4 <> 0 GROUP BY 1), oth AS (SELECT period, max_by(value, (-source_rank, vintage)) AS v FROM vin WHERE source_rank <> 1 GROUP BY 1)
SELECT o.period::VARCHAR AS period, coalesce(own.v, o.v) AS value, own.v IS NULL AS fell_back FROM oth o LEFT JOIN own USING (period)""")
def prior_source_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The own source's latest value, else that of the first other source."""
    v = vintages(spark, d)
    own = v.where("source_rank = 1 AND month(period) % 4 <> 0").groupBy("period").agg(F.max_by("value", "vintage").alias("own"))
    other = v.where("source_rank <> 1").groupBy("period").agg(F.max_by("value", F.struct((-F.col("source_rank")).alias("r"), "vintage")).alias("other"))
    j = other.join(own, "period", "left")
    return j.select(F.col("period").cast("string").alias("period"), F.coalesce("own", "other").alias("value"), F.col("own").isNull().alias("fell_back"))


@query(f"""WITH {VIN}, l AS (SELECT period, source_rank, max_by(value, vintage) AS v FROM vin GROUP BY ALL) SELECT period::VARCHAR AS period, count(*) AS providers, max(v) - min(v) > 0.0005::DOUBLE * abs(min(v)) AS disagree FROM l GROUP BY period""")
def cross_provider_compare(spark: SparkSession, d: str) -> DataFrame:
    latest = vintages(spark, d).groupBy("period", "source_rank").agg(F.max_by("value", "vintage").alias("v"))
    return latest.groupBy(F.col("period").cast("string").alias("period")).agg(F.count("*").alias("providers"), (F.max("v") - F.min("v") > 0.0005 * F.abs(F.min("v"))).alias("disagree"))


@query(f"""WITH {VIN}, a(asked, before) AS (VALUES (DATE '1996-05-01', DATE '1996-06-15'), (DATE '1997-01-01', DATE '1996-12-01'), (DATE '1990-01-01', DATE '1999-01-01'))
SELECT asked::VARCHAR AS asked, period::VARCHAR AS period, value FROM a JOIN vin ON period <= asked AND vintage < before QUALIFY row_number() OVER (PARTITION BY asked ORDER BY period DESC, vintage DESC, source_rank DESC) = 1""")
def exact_or_nearest_earlier(spark: SparkSession, d: str) -> DataFrame:
    """The asked period or the nearest earlier one, as known before a moment."""
    a = spark.createDataFrame([("1996-05-01", "1996-06-15"), ("1997-01-01", "1996-12-01"), ("1990-01-01", "1999-01-01")], "asked string, before string")
    v = vintages(spark, d).join(F.broadcast(a), (F.col("period") <= F.col("asked").cast("date")) & (F.col("vintage") < F.col("before").cast("date")))  # three rows
    best = v.groupBy("asked").agg(F.max_by(F.struct("period", "value"), F.struct("period", "vintage", "source_rank")).alias("r"))
    return best.select("asked", F.col("r.period").cast("string").alias("period"), "r.value")


@query("""WITH l AS (SELECT l_orderkey, count(*) AS lines, count(*) FILTER (l_linestatus = 'F') AS done, max(l_shipdate)::DATE AS last FROM lineitem GROUP BY 1)
SELECT o_orderkey, lines, done, CASE WHEN done = lines THEN 'complete' WHEN date_diff('day', o_orderdate::DATE, last) > 90 THEN 'expired' WHEN done > 0 THEN 'partial' ELSE 'waiting' END AS state FROM orders JOIN l ON l_orderkey = o_orderkey""")
def release_state(spark: SparkSession, d: str) -> DataFrame:
    """Complete once as many parts are in as the release has; else expired, partial or waiting."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.count_if(F.col("l_linestatus") == "F").alias("done"), F.to_date(F.max("l_shipdate")).alias("last"))  # noqa: E741
    late = F.datediff("last", F.to_date("o_orderdate")) > 90
    state = F.when(F.col("done") == F.col("lines"), "complete").when(late, "expired").when(F.col("done") > 0, "partial").otherwise("waiting")
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").join(l, "o_orderkey").select("o_orderkey", "lines", "done", state.alias("state"))


@query("""SELECT event_id, user_id, round(used, 4) AS used, used <= 500 AS granted FROM (SELECT event_id, user_id, sum(value) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS used FROM events)""")
def budget_reservation(spark: SparkSession, d: str) -> DataFrame:
    """Requests of a user and day until their running cost passes 500."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    e = events(spark, d).withColumn("used", F.sum("value").over(w))
    return e.select("event_id", "user_id", F.round("used", 4).alias("used"), (F.col("used") <= 500).alias("granted"))


@query("""WITH r AS (SELECT user_id % 40 AS content, count(*) AS n_views, count(*) FILTER (value >= 30) AS reads FROM events WHERE event_type = 'view' GROUP BY 1) SELECT k AS content, coalesce(n_views, 0) AS n_views, coalesce(reads, 0) AS reads FROM range(45) t(k) LEFT JOIN r ON content = k""")
def reads_vs_views(spark: SparkSession, d: str) -> DataFrame:
    """Views and reads of asked contents, zeros for those without any."""
    r = events(spark, d).where("event_type = 'view'").groupBy((F.col("user_id") % 40).alias("content")).agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 30).alias("r"))
    return spark.range(45).withColumnRenamed("id", "content").join(r, "content", "left").select("content", F.coalesce("n", F.lit(0)).alias("n_views"), F.coalesce("r", F.lit(0)).alias("reads"))


@query("""SELECT coalesce(source, '*') AS source, coalesce(lang, '*') AS lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((), (source), (lang), (source, lang))""")
def publish_stats(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").groupingSets([[], [F.col("source")], [F.col("lang")], [F.col("source"), F.col("lang")]], F.col("source"), F.col("lang")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return g.select(F.coalesce("source", F.lit("*")).alias("source"), F.coalesce("lang", F.lit("*")).alias("lang"), "n", "chars")


@query("""SELECT event_id, sha256(concat('secret', chr(124), strftime(ts, '%Y-%m-%d'), chr(124), user_id, chr(124), event_type)) AS pseudonym FROM events""")
def daily_pseudonym(spark: SparkSession, d: str) -> DataFrame:
    """An id that changes every day, so visits of different days cannot be joined."""
    key = F.concat_ws("|", F.lit("secret"), F.date_format("ts", "yyyy-MM-dd"), F.col("user_id").cast("string"), F.col("event_type"))
    return events(spark, d).select("event_id", F.sha2(key, 256).alias("pseudonym"))


@query("""SELECT event_id, event_type FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) AND NOT starts_with(event_type, 'err')""")
def internal_traffic_purge(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("user_id"))
    return events(spark, d).where(~F.col("event_type").startswith("err")).join(own, "user_id", "left_anti").select("event_id", "event_type")


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages) SELECT page_id, CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END AS path,
CASE WHEN regexp_matches(path, '^/[a-z]{2}/[0-9]+/?$') THEN 'article' WHEN regexp_matches(path, '^/[a-z]{2}/?$') THEN 'home' ELSE 'other' END AS template, nullif(regexp_extract(path, '^/[a-z]{2}/([0-9]+)/?$', 1), '') AS content_id FROM p""")
def path_template(spark: SparkSession, d: str) -> DataFrame:
    """Normalised path, the template it belongs to, and the id of its content."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    short = F.regexp_replace("path", "/+$", "")
    template = F.when(F.col("path").rlike("^/[a-z]{2}/[0-9]+/?$"), "article").when(F.col("path").rlike("^/[a-z]{2}/?$"), "home").otherwise("other")
    return p.select("page_id", F.when(short == "", "/").otherwise(short).alias("path"), template.alias("template"), F.nullif(F.regexp_extract("path", "^/[a-z]{2}/([0-9]+)/?$", 1), F.lit("")).alias("content_id"))


@query("""SELECT event_type AS section, count(*) AS shown, count(*) FILTER (value >= 50) AS dwelt, round(avg(value), 4) AS mean_seconds, count(DISTINCT user_id) AS visitors, coalesce(any_value(x.exits), 0) AS exits FROM events LEFT JOIN (SELECT event_type AS t, count(*) AS exits FROM (SELECT max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id) GROUP BY 1) x ON x.t = event_type GROUP BY 1""")
def section_heat(spark: SparkSession, d: str) -> DataFrame:
    """Attention per section, with the visitors who left there last."""
    e = events(spark, d)
    exits = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("section")).groupBy("section").agg(F.count("*").alias("exits"))
    g = e.groupBy(F.col("event_type").alias("section")).agg(F.count("*").alias("shown"), F.count_if(F.col("value") >= 50).alias("dwelt"), F.round(F.avg("value"), 4).alias("mean_seconds"), F.count_distinct("user_id").alias("visitors"))
    return g.join(exits, "section", "left").withColumn("exits", F.coalesce("exits", F.lit(0)))


@query(r"""SELECT doc_id, length(regexp_replace(text, '[^0-9]', '', 'g')) * 4 > length(text) OR length(text) < 40 OR NOT regexp_matches(text, '[.!?]$') AS fragment FROM documents""")
def fragment_detector(spark: SparkSession, d: str) -> DataFrame:
    """Texts that are mostly digits, very short, or do not end a sentence."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", ((F.length(F.regexp_replace(t, "[^0-9]", "")) * 4 > F.length(t)) | (F.length(t) < 40) | ~t.rlike(r"[.!?]\z")).alias("fragment"))


@query(r"""WITH s AS (SELECT doc_id, text, regexp_extract(regexp_replace(text, '^[#*\-\s]+', ''), '^([^.!?\n]{12,}[.!?])', 1) AS s FROM documents) SELECT doc_id, CASE WHEN s <> '' THEN s ELSE left(regexp_replace(text, '\s+', ' ', 'g'), 120) END AS summary FROM s""")
def lead_sentence(spark: SparkSession, d: str) -> DataFrame:
    """The first sentence of 12 characters or more at the head of a text, else its first 120 characters."""
    s = table(spark, d, "documents").select("doc_id", "text", F.regexp_extract(F.regexp_replace("text", r"^[#*\-\s]+", ""), r"^([^.!?\n]{12,}[.!?])", 1).alias("s"))
    return s.select("doc_id", F.when(F.col("s") != "", F.col("s")).otherwise(F.left(F.regexp_replace("text", r"\s+", " "), F.lit(120))).alias("summary"))


@query("""SELECT doc_id, strpos(lower(text), ' the ') AS at, CASE WHEN strpos(lower(text), ' the ') > 0 THEN substr(text, greatest(1, strpos(lower(text), ' the ') - 60), 190) ELSE left(text, 190) END AS snippet FROM documents""")
def snippet(spark: SparkSession, d: str) -> DataFrame:
    """190 characters around the first match, or from the start."""
    at = F.instr(F.lower("text"), " the ")
    s = table(spark, d, "documents").select("doc_id", "text", at.cast("long").alias("at"))
    return s.select("doc_id", "at", F.when(F.col("at") > 0, F.substr("text", F.greatest(F.lit(1), F.col("at") - 60).cast("int"), F.lit(190))).otherwise(F.left("text", F.lit(190))).alias("snippet"))


@query("""WITH k AS (SELECT page_id, unnest(list_distinct(list_filter(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.'), lambda x: length(x) > 3))) AS word FROM pages) SELECT word, count(*) AS n, min(page_id) AS first_page FROM k GROUP BY 1 HAVING count(*) > 1""")
def keyword_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Host words that several pages claim."""
    ws = F.array_distinct(F.filter(F.split(F.regexp_extract("url", "://([^/?#]*)", 1), r"\."), lambda x: F.length(x) > 3))
    return table(spark, d, "pages").select("page_id", F.explode(ws).alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).where("n > 1")


@query("""SELECT page_id, ((regexp_matches(url, '/en/'))::INT * 3 + (regexp_matches(url, '^https:'))::INT * 2 - (contains(url, '?'))::INT * 2 - (contains(url, '#'))::INT - length(url) // 40)::BIGINT AS score FROM pages""")
def url_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Relevance of an address from its parts."""
    one = lambda c: c.cast("int")
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", (one(u.rlike("/en/")) * 3 + one(u.rlike("^https:")) * 2 - one(F.contains(u, F.lit("?"))) * 2 - one(F.contains(u, F.lit("#"))) - F.floor(F.length(u) / 40)).cast("long").alias("score"))


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'hit' ELSE 'miss' END AS outcome, ceil(length(text) / 4.0::DOUBLE)::BIGINT AS tokens, role FROM conversations)
SELECT role, count(*) AS calls, count(*) FILTER (outcome = 'hit') AS hits, round(count(*) FILTER (outcome = 'hit') * 100.0::DOUBLE / count(*), 1) AS hit_pct, coalesce(sum(tokens) FILTER (outcome = 'hit'), 0)::BIGINT AS avoided FROM c GROUP BY 1""")
def cache_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    hit = F.col("turn") % 3 == 0
    g = table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("calls"), F.count_if(hit).alias("hits"), F.coalesce(F.sum(F.when(hit, F.ceil(F.length("text") / F.lit(4.0)))), F.lit(0)).cast("long").alias("avoided"))
    return g.select("role", "calls", "hits", rate(F.col("hits"), F.col("calls")).alias("hit_pct"), "avoided")


@query("""WITH a AS (SELECT doc_id, lang AS l1, CASE WHEN regexp_matches(text, '(^|[^a-z])(the|of|and)([^a-z]|$)') THEN 'en' WHEN regexp_matches(text, '(^|[^a-z])(und|der|die)([^a-z]|$)') THEN 'de' WHEN regexp_matches(text, '(^|[^a-z])(les|des|une)([^a-z]|$)') THEN 'fr' ELSE 'es' END AS l2 FROM documents)
SELECT l1, l2, count(*) AS n, l1 = l2 AS agree FROM a GROUP BY ALL""")
def agreement_summary(spark: SparkSession, d: str) -> DataFrame:
    """How a rule's answers agree with the stored ones, as counts per pair of answers."""
    t = F.col("text")
    l2 = F.when(t.rlike("(^|[^a-z])(the|of|and)([^a-z]|$)"), "en").when(t.rlike("(^|[^a-z])(und|der|die)([^a-z]|$)"), "de").when(t.rlike("(^|[^a-z])(les|des|une)([^a-z]|$)"), "fr").otherwise("es")
    return table(spark, d, "documents").select(F.col("lang").alias("l1"), l2.alias("l2")).groupBy("l1", "l2").agg(F.count("*").alias("n")).withColumn("agree", F.col("l1") == F.col("l2"))


@query("""WITH s AS (SELECT doc_id, n_chars, source FROM documents) SELECT count(*) AS documents, count(DISTINCT source) AS sources, sum(n_chars)::BIGINT AS chars, (SELECT count(*) FROM events) AS events, (SELECT count(DISTINCT user_id) FROM events) AS users, (SELECT count(*) FROM labels WHERE toxic = 1) AS toxic, (SELECT count(*) FROM pages) AS pages FROM s""")
def daily_report(spark: SparkSession, d: str) -> DataFrame:
    """One row of figures from several tables; each is a one-row aggregate."""
    doc = table(spark, d, "documents").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"), F.sum("n_chars").alias("chars"))
    e = events(spark, d).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))
    t = table(spark, d, "labels").agg(F.count_if(F.col("toxic") == 1).alias("toxic"))
    return doc.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(t)).crossJoin(F.broadcast(table(spark, d, "pages").agg(F.count("*").alias("pages"))))


@query("""SELECT o_orderkey, array_to_string(list_concat(list_slice(l, o_orderkey % 4 + 1, 4), list_slice(l, 1, o_orderkey % 4)), ',') AS rotated FROM (SELECT o_orderkey, ['a', 'b', 'c', 'd'] AS l FROM orders)""")
def rotated_list(spark: SparkSession, d: str) -> DataFrame:
    """A list rotated by a number per row."""
    a, k = F.array(*map(F.lit, "abcd")), (F.col("o_orderkey") % 4).cast("int")
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws(",", F.slice(a, k + 1, F.lit(4)), F.slice(a, F.lit(1), k)).alias("rotated"))


@query("""WITH c AS (SELECT source, count(*) AS n, count(*) FILTER (n_chars >= 700) AS long_texts, max(doc_id) AS newest FROM documents GROUP BY 1) SELECT source, n, long_texts, newest FROM c WHERE long_texts >= 2 ORDER BY long_texts DESC, source LIMIT 10""")
def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") >= 700).alias("long_texts"), F.max("doc_id").alias("newest"))
    return g.where("long_texts >= 2").orderBy(F.desc("long_texts"), "source").limit(10)


@query("""SELECT o_custkey AS custkey, o_orderkey AS orderkey, lag(o_orderkey) OVER w AS previous, round(o_totalprice - lag(o_totalprice) OVER w, 2) AS delta FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def adjacent_editions(spark: SparkSession, d: str) -> DataFrame:
    """Each edition with the one before it of the same publisher."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.lag("o_orderkey").over(w).alias("previous"), F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2).alias("delta"))


@query("""SELECT day, event_type, event_id FROM (SELECT ts::DATE::VARCHAR AS day, event_type, event_id, row_number() OVER (PARTITION BY ts::DATE, event_type ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk = 1""")
def last_per_day(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each day and type, as a map-side aggregate."""
    return events(spark, d).groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query()
def evidence_selection(spark: SparkSession, d: str) -> DataFrame:
    """Sentences by score until 1,200 characters are full; one that does not fit is skipped and smaller ones still try.

    Greedy choice with skips is sequential, so it is a fold over the sorted sentences of a row: no shuffle, no group. A
    row is a document. The fold carries what is left and what is kept, 1,200 sentences at most.
    """
    score = lambda x, i: F.when(i < 3, 2).otherwise(0) + F.when(x.rlike("[0-9]"), 3).otherwise(0)
    told = F.transform(sentences(F.col("text")), lambda x, i: F.struct((-score(x, i)).alias("rank"), i.alias("pos"), F.length(x).alias("size")))
    s = table(spark, d, "documents").select("doc_id", F.array_sort(told).alias("told"))
    start = F.struct(F.lit(1200).alias("left"), F.array().cast("array<struct<rank:int,pos:int,size:int>>").alias("kept"))
    keep = lambda acc, x: F.when(x["size"] <= acc["left"], F.struct((acc["left"] - x["size"]).alias("left"), F.array_append(acc["kept"], x).alias("kept"))).otherwise(acc)
    kept = s.select("doc_id", F.explode(F.aggregate("told", start, keep, lambda acc: acc["kept"])).alias("k"))
    return kept.select("doc_id", "k.pos", "k.size", (-F.col("k.rank")).alias("score"))


@query("""SELECT n_regionkey AS region, p_brand AS brand, n FROM (SELECT n_regionkey, p_brand, count(*) AS n, row_number() OVER (PARTITION BY n_regionkey ORDER BY count(*) DESC, p_brand) AS rk FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2) WHERE rk <= 3""")
def facet_discovery(spark: SparkSession, d: str) -> DataFrame:
    """The three most frequent facets of each region."""
    li = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("region"))
    g = li.join(p, "l_partkey").join(s, "l_suppkey").groupBy("region", "brand").agg(F.sum("n").alias("n"))
    return top_per_group(g, ["region"], [F.desc("n"), F.col("brand")], 3).select("region", "brand", "n")
