"""Text checks: topic votes, targets and signs in sentences, policy statements and their changes, translations, issue lists.

Sentences are put together from the tables' values, so that what a rule finds can be held against them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions.scalar import half_even, rate
from lodestream.operators.relational import top_per_group
from lodestream.plans.base import query
from lodestream.plans.behaviour import events
from lodestream.session import table

#: Words that speak for research; two of them make a topic.
SIGNALS = [
    "research", "outlook", "markets?", "econom(y|ic|ics)", "invest(ment|ing|or)", "portfolio", "assets?", "equit(y|ies)", "bonds?", "yields?", "inflation",
    "commodit(y|ies)", "currenc(y|ies)", "forex", "monetary", "gdp", "earnings", "valuation", "forecast", "(employment|unemployment|jobs?|labou?r|wages?)",
]

NOTES = """notes AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'The outlook for bonds and yields' WHEN 1 THEN 'A word on outlooks' WHEN 2 THEN 'Jobs and wages: GDP forecast' WHEN 3 THEN 'Marketing and researchers' ELSE 'Equity market notes' END || ' of ' || o_orderpriority AS title,
'We move our target for the share from $' || CAST(floor(o_totalprice / 10) AS BIGINT) || CASE WHEN o_custkey % 2 = 0 THEN ' to $' || (CAST(floor(o_totalprice / 10) AS BIGINT) + o_custkey) ELSE '' END || '.' || chr(10) || 'Revenue was $12,000 in 1999. Our price objective stays near $ ' || format('{:,}', CAST(floor(o_totalprice / 7) AS BIGINT)) || '.50 for now.' AS body FROM orders)"""


def notes(spark: SparkSession, d: str) -> DataFrame:
    """(o_orderkey, title, body): a note an order."""
    k, base = F.col("o_orderkey") % 5, F.floor(F.col("o_totalprice") / 10)
    head = F.when(k == 0, "The outlook for bonds and yields").when(k == 1, "A word on outlooks").when(k == 2, "Jobs and wages: GDP forecast").when(k == 3, "Marketing and researchers").otherwise("Equity market notes")
    then = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit(" to $"), (base + F.col("o_custkey")).cast("string"))).otherwise("")
    near = F.regexp_replace(F.format_number(F.floor(F.col("o_totalprice") / 7), 0), "$", ".50 for now.")
    body = F.concat(F.lit("We move our target for the share from $"), base.cast("string"), then, F.lit(".\nRevenue was $12,000 in 1999. Our price objective stays near $ "), near)
    return table(spark, d, "orders").select("o_orderkey", F.concat(head, F.lit(" of "), "o_orderpriority").alias("title"), body.alias("body"))


_VOTES_SQL = " + ".join(rf"regexp_matches(lower(title), '\b{p}\b')::INT" for p in SIGNALS)


@query(f"WITH {NOTES} SELECT o_orderkey, {_VOTES_SQL} AS votes, ({_VOTES_SQL}) >= 2 AS is_topic FROM notes")
def topic_vote(spark: SparkSession, d: str) -> DataFrame:
    """How many kinds of research words a title has; two make it a research topic."""
    low = F.lower("title")
    votes = sum((F.regexp_like(low, F.lit(rf"\b{p}\b")).cast("int") for p in SIGNALS), F.lit(0))
    return notes(spark, d).withColumn("votes", votes).select("o_orderkey", "votes", (F.col("votes") >= 2).alias("is_topic"))


#: Words that introduce a target, and how far from them its amount may stand.
CUES, NEAR, LEAST, MOST = "target|forecast|price objective", 60, 1, 200_000


def stated_target(body: Column) -> tuple[Column, Column]:
    """(target, previous) that a text states, whatever the case: "from X to Y" (or an arrow) behind a word of the trade, else the last amount of money behind one.

    A text is cut at those words and each piece is read up to the end of its sentence. Amounts have two to eight digits and
    commas; other amounts of money are none.
    """
    amount = r"\$?\s*([0-9][0-9,]{1,7}(?:\.[0-9]+)?)"
    cut = F.split(F.lower(body), CUES)
    pieces = F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0)))
    moved = rf"^[^.\n]{{0,{NEAR}}}?from\s*{amount}\s*(?:to|->|→)\s*{amount}"
    value = lambda piece, form, k: F.regexp_replace(F.regexp_extract(piece, form, k), ",", "").try_cast("double")
    from_to = F.try_element_at(F.filter(F.transform(pieces, lambda p: F.struct(value(p, moved, 1).alias("before"), value(p, moved, 2).alias("after"))), lambda x: x["after"].isNotNull()), F.lit(1))
    money = F.filter(F.transform(pieces, lambda p: value(p, rf"^[^.\n$]{{0,{NEAR}}}(?=\$){amount}", 1)), lambda x: x.between(LEAST, MOST))
    return F.coalesce(from_to["after"], F.try_element_at(money, F.lit(-1))), from_to["before"]


_AMOUNT = r"\$? *([0-9][0-9,]{1,7}(?:\.[0-9]+)?)"


@query(rf"""WITH {NOTES}, p AS (SELECT o_orderkey, regexp_split_to_array(lower(body), '{CUES}')[2:] AS ps FROM notes),
m AS (SELECT o_orderkey, list_filter(ps, lambda x: regexp_matches(x, '^[^.]*from {_AMOUNT} to {_AMOUNT}'))[1] AS moved, list_filter(list_transform(ps, lambda x: regexp_extract(x, '^[^.$]*\$ *([0-9][0-9,]{{1,7}}(?:\.[0-9]+)?)', 1)), lambda x: x <> '') AS said FROM p)
SELECT o_orderkey, CASE WHEN moved IS NOT NULL THEN replace(regexp_extract(moved, 'from {_AMOUNT} to {_AMOUNT}', 2), ',', '')::DOUBLE ELSE list_filter([replace(x, ',', '')::DOUBLE FOR x IN said], lambda x: x BETWEEN {LEAST} AND {MOST})[-1] END AS target,
replace(regexp_extract(moved, 'from {_AMOUNT} to {_AMOUNT}', 1), ',', '')::DOUBLE AS previous FROM m""")
def targets_in_text(spark: SparkSession, d: str) -> DataFrame:
    """A target "from X to Y", else the last amount that a target word introduces; other amounts are none."""
    target, previous = stated_target(F.col("body"))
    return notes(spark, d).select("o_orderkey", target.alias("target"), previous.alias("previous"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.08 THEN 1 WHEN l_discount <= 0.01 THEN -1 WHEN l_tax = 0 THEN NULL ELSE 0 END AS sign FROM lineitem)
SELECT l_orderkey, count(sign) AS explicit, CASE WHEN count(sign) = 0 OR count(DISTINCT nullif(sign, 0)) > 1 THEN NULL ELSE coalesce(max(nullif(sign, 0)), 0) END AS direction FROM s GROUP BY 1""")
def sign_conflict(spark: SparkSession, d: str) -> DataFrame:
    """The direction that segments agree on; null if they contradict each other or none says anything."""
    sign = F.when(F.col("l_discount") >= 0.08, 1).when(F.col("l_discount") <= 0.01, -1).when(F.col("l_tax") != 0, 0)
    s = table(spark, d, "lineitem").select("l_orderkey", sign.alias("sign")).withColumn("side", F.when(F.col("sign") != 0, F.col("sign")))
    g = s.groupBy("l_orderkey").agg(F.count("sign").alias("explicit"), F.min("side").alias("low"), F.max("side").alias("high"))
    return g.select("l_orderkey", "explicit", F.when((F.col("explicit") > 0) & (F.col("low").isNull() | (F.col("low") == F.col("high"))), F.coalesce("high", F.lit(0))).alias("direction"))


MEETINGS = """meet AS (SELECT date_trunc('month', o_orderdate)::DATE AS day, count(*) % 3 AS k, count(*) % 40 AS n FROM orders GROUP BY 1), st AS (SELECT day, 'The board ' || CASE k WHEN 0 THEN 'decided to raise' WHEN 1 THEN 'agreed to lower' ELSE 'decided to keep' END || ' the target range for the policy rate' ||
CASE WHEN k < 2 THEN ' by ' || CASE WHEN n % 2 = 0 THEN '25 basis points' ELSE '1/2 percentage point' END ELSE '' END || ', to ' || (n // 8) || CASE WHEN n % 8 > 0 THEN '-' || (n % 8) || '/8' ELSE '' END || ' to ' || (n // 8 + 1) || ' percent. It was adopted by a ' || (n % 9 + 3) || '-' || (n % 3) || ' vote.' AS body FROM meet)"""
_POLICY_SQL = r"""pol AS (SELECT day, CASE WHEN regexp_matches(body, '(?:decided|agreed) to (?:raise|increase)') THEN 'HIKE' WHEN regexp_matches(body, '(?:decided|agreed) to (?:lower|reduce)') THEN 'CUT' WHEN regexp_matches(body, '(?:decided|agreed) to (?:maintain|keep|retain)') THEN 'HOLD' ELSE 'OTHER' END AS decision,
regexp_extract(body, 'by ([0-9/.]+) (basis|percentage) point', 1) AS a, regexp_extract(body, 'by ([0-9/.]+) (basis|percentage) point', 2) AS u, regexp_extract(body, ', to ([0-9]+(?:-[0-9]/[0-9])?) to ([0-9]+) percent', 1) AS lo, regexp_extract(body, ', to ([0-9]+(?:-[0-9]/[0-9])?) to ([0-9]+) percent', 2)::DOUBLE AS upper,
regexp_extract(body, 'by a ([0-9]+)-([0-9]+) vote', 1)::BIGINT AS votes_for, regexp_extract(body, 'by a ([0-9]+)-([0-9]+) vote', 2)::BIGINT AS votes_against FROM st),
p AS (SELECT day, decision, CASE WHEN decision = 'HOLD' THEN 0 ELSE CASE WHEN contains(a, '/') THEN split_part(a, '/', 1)::DOUBLE / split_part(a, '/', 2)::DOUBLE ELSE a::DOUBLE END * CASE WHEN u = 'basis' THEN 1 ELSE 100 END * CASE WHEN decision = 'CUT' THEN -1 ELSE 1 END END AS change_bps,
split_part(lo, '-', 1)::DOUBLE + CASE WHEN contains(lo, '-') THEN split_part(split_part(lo, '-', 2), '/', 1)::DOUBLE / split_part(lo, '/', 2)::DOUBLE ELSE 0 END AS lower, upper, votes_for, votes_against FROM pol)"""


def statements(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").groupBy(F.to_date(F.trunc("o_orderdate", "month")).alias("day")).agg((F.count("*") % 3).alias("k"), (F.count("*") % 40).alias("n"))
    n, s = F.col("n"), lambda c: c.cast("string")
    verb = F.when(F.col("k") == 0, "decided to raise").when(F.col("k") == 1, "agreed to lower").otherwise("decided to keep")
    step = F.when(F.col("k") < 2, F.concat(F.lit(" by "), F.when(n % 2 == 0, "25 basis points").otherwise("1/2 percentage point"))).otherwise("")
    whole = F.floor(n / 8)
    low = F.concat(s(whole), F.when(n % 8 > 0, F.concat(F.lit("-"), s(n % 8), F.lit("/8"))).otherwise(""))
    body = F.concat(F.lit("The board "), verb, F.lit(" the target range for the policy rate"), step, F.lit(", to "), low, F.lit(" to "), s(whole + 1), F.lit(" percent. It was adopted by a "), s(n % 9 + 3), F.lit("-"), s(n % 3), F.lit(" vote."))
    return m.select("day", body.alias("body"))


def fraction(t: Column) -> Column:
    """A number written as 5, 5.25, 1/2, 5-1/4, 5 1/4 or 5¼; null if it is none."""
    for sign, spelled in (("¼", " 1/4"), ("½", " 1/2"), ("¾", " 3/4")):
        t = F.replace(t, F.lit(sign), F.lit(spelled))
    parts = F.filter(F.split(F.trim(t), "[ -]+"), lambda x: x != "")
    one = lambda x: F.when(F.contains(x, F.lit("/")), F.split_part(x, F.lit("/"), F.lit(1)).try_cast("double") / F.nullif(F.split_part(x, F.lit("/"), F.lit(2)).try_cast("double"), F.lit(0.0))).otherwise(x.try_cast("double"))
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, x: s + one(x)))


#: What a verb before "target range" decides, by its stem.
DECISIONS = {"rais": "HIKE", "increas": "HIKE", "lower": "CUT", "reduc": "CUT", "maintain": "HOLD", "keep": "HOLD", "kept": "HOLD", "retain": "HOLD"}


def policies(statements: DataFrame) -> DataFrame:
    """(day, decision, change_bps, lower, upper, votes_for, votes_against) of policy statements (day, body).

    A statement is cut at "target range" and at its lists of votes: the last verb before the range decides, step and bounds
    stand around it, and what voters preferred decides nothing. Votes are a tally, else the names that are listed.
    """
    body = F.regexp_replace("body", r"\s+", " ")
    sections = F.split(body, r"(?i)(?=voting (?:for|against) )")
    head = sections[0]
    ahead, behind = F.split_part(F.lower(head), F.lit("target range"), F.lit(1)), F.substring_index(F.lower(head), "target range", -1)
    ranged = F.contains(F.lower(head), F.lit("target range"))
    stems = F.regexp_extract_all(F.right(ahead, F.lit(180)), F.lit(rf"\b({'|'.join(DECISIONS)})"), F.lit(1))
    last = F.try_element_at(stems, F.lit(-1))
    decision = F.coalesce(F.when(ranged, F.coalesce(*[F.when(last == k, v) for k, v in DECISIONS.items()])), F.lit("OTHER"))
    rate = r"([0-9]+(?:\.[0-9]+)?(?:[- ][0-9]+/[0-9]+)?|[0-9]+/[0-9]+|[0-9]*[¼½¾])"
    step, bounds = rf"\bby {rate} (basis|percentage) points?", rf"{rate} (?:to|and|–|—) {rate} percent"
    near = F.left(behind, F.lit(300))
    by = lambda k: F.coalesce(F.nullif(F.regexp_extract(near, step, k), F.lit("")), F.nullif(F.regexp_extract(F.right(ahead, F.lit(120)), step, k), F.lit("")))
    tally = lambda k: F.regexp_extract(head, r"(?i)by an? (\d+) ?[–—-] ?(\d+) vote", k).try_cast("long")

    def listed(side: str) -> Column:
        own = F.get(F.filter(sections, lambda x: F.startswith(F.lower(x), F.lit(f"voting {side} "))), F.lit(0))
        names = F.regexp_replace(F.regexp_extract(own, r"(?:were|was) (.*)$", 1), r"(?i)(,? who .*|\. (?:absent|voting).*|\. ?)$", "")
        people = F.filter(F.split(names, r",? and |, "), lambda x: F.trim(x) != "")
        proper = F.forall(people, lambda x: x.rlike(r"[A-Z][\w.'’-]+( [A-Z][\w.'’-]*)+"))
        return F.when(own.isNotNull() & (F.size(people) > 0) & proper, F.size(people).cast("long"))

    ayes, noes = listed("for"), listed("against")
    rows = statements.select(
        "day", decision.alias("decision"), by(1).alias("by"), by(2).alias("unit"), F.regexp_extract(near, bounds, 1).alias("low"), F.regexp_extract(near, bounds, 2).alias("high"),
        F.coalesce(tally(1), ayes).alias("votes_for"), F.coalesce(tally(2), noes, F.when(ayes.isNotNull(), F.lit(0).cast("long"))).alias("votes_against"),
    )
    change = fraction(F.col("by")) * F.when(F.col("unit") == "basis", 1).otherwise(100) * F.when(F.col("decision") == "CUT", -1).otherwise(1)
    bound = lambda c: fraction(F.nullif(F.col(c), F.lit("")))
    return rows.select("day", "decision", F.when(F.col("decision") == "HOLD", 0.0).when(F.col("decision") != "OTHER", change).alias("change_bps"), bound("low").alias("lower"), bound("high").alias("upper"), "votes_for", "votes_against")


@query(f"WITH {MEETINGS}, {_POLICY_SQL} SELECT day::VARCHAR AS day, decision, change_bps, lower, upper, votes_for, votes_against FROM p")
def policy_statement(spark: SparkSession, d: str) -> DataFrame:
    """Decision, step, range and votes that a statement says."""
    return policies(statements(spark, d)).withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {MEETINGS}, {_POLICY_SQL}, l AS (SELECT *, lag(decision) OVER w AS d0, lag(upper) OVER w AS u0, lag(votes_against) OVER w AS v0, lag(day) OVER w AS before FROM p WINDOW w AS (ORDER BY day))
SELECT day::VARCHAR AS day, before::VARCHAR AS previous, concat_ws('; ', CASE WHEN decision <> d0 THEN 'decision: ' || decision END, CASE WHEN upper <> u0 THEN 'upper: ' || CAST(upper AS BIGINT) END, CASE WHEN votes_against <> v0 THEN 'votes_against: ' || votes_against END) AS changes FROM l WHERE before IS NOT NULL""")
def statement_diff(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a statement that differ from the one before, with their new values."""
    p = policies(statements(spark, d)).select("day", "decision", F.col("upper").cast("long").cast("string").alias("upper"), F.col("votes_against").cast("string").alias("votes_against"))
    fields = ["decision", "upper", "votes_against"]
    w = Window.orderBy("day")  # one row a meeting
    p = p.select("*", *[F.lag(c).over(w).alias(f"{c}_0") for c in ("day", *fields)]).where("day_0 IS NOT NULL")
    changed = [F.when(F.col(c) != F.col(f"{c}_0"), F.concat(F.lit(f"{c}: "), F.col(c))) for c in fields]
    return p.select(F.col("day").cast("string").alias("day"), F.col("day_0").cast("string").alias("previous"), F.concat_ws("; ", *changed).alias("changes"))


PAIRS = """pr AS (SELECT l_orderkey, l_linenumber, 'Sales of ' || CAST(l_extendedprice AS BIGINT) || ' units at ' || CAST(l_quantity AS BIGINT) || '.0% in 1998; ACME-' || l_suppkey AS src,
'销售 ' || CASE l_linenumber % 3 WHEN 0 THEN CAST(l_extendedprice AS BIGINT)::VARCHAR WHEN 1 THEN (CAST(l_extendedprice AS BIGINT) * 10000)::VARCHAR ELSE (CAST(l_extendedprice AS BIGINT) + 1)::VARCHAR END || ' 单位, ' || CAST(l_quantity AS BIGINT) || '%' || CASE WHEN l_suppkey % 2 = 0 THEN ' ACME-' || l_suppkey ELSE '' END AS dst FROM lineitem)"""
_TOKENS_SQL = "list_distinct(list_filter([x::DOUBLE FOR x IN regexp_extract_all(regexp_replace({c}, 'ACME-[0-9]+', '', 'g'), '[0-9]+(?:\\.[0-9]+)?')], lambda x: x NOT BETWEEN 1900 AND 2199 OR x <> floor(x)))"
_SCALES_SQL = "[v FOR v IN [x, x * 1e4, x / 1e4, x * 1e8, x / 1e8]]"


@query(f"""WITH {PAIRS}, t AS (SELECT *, {_TOKENS_SQL.format(c='src')} AS s, {_TOKENS_SQL.format(c='dst')} AS g FROM pr),
i AS (SELECT l_orderkey, l_linenumber, len(list_filter(s, lambda x: NOT list_has_any({_SCALES_SQL}, g))) AS missing, len(list_filter(g, lambda x: NOT list_has_any({_SCALES_SQL}, s))) AS added, (NOT contains(dst, regexp_extract(src, 'ACME-[0-9]+')))::INT AS tickers FROM t)
SELECT l_orderkey, l_linenumber, missing, added, tickers AS tickers_missing, round(greatest(0, 1 - (missing + added + tickers) * 0.12::DOUBLE), 2) AS score FROM i""")
def translation_check(spark: SparkSession, d: str) -> DataFrame:
    """Figures and names of a text that its translation lacks, and figures that it adds; a figure counts at any scale of 10^4 or 10^8, years do not count."""
    price, quantity, n, name = half_even(F.col("l_extendedprice")), half_even(F.col("l_quantity")).cast("string"), F.col("l_linenumber") % 3, F.concat(F.lit("ACME-"), F.col("l_suppkey").cast("string"))
    told = F.when(n == 0, price).when(n == 1, price * 10000).otherwise(price + 1).cast("string")
    src = F.concat(F.lit("Sales of "), price.cast("string"), F.lit(" units at "), quantity, F.lit(".0% in 1998; "), name)
    dst = F.concat(F.lit("销售 "), told, F.lit(" 单位, "), quantity, F.lit("%"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit(" "), name)).otherwise(""))
    p = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", src.alias("src"), dst.alias("dst"), name.alias("name"))
    # A list of names goes first: their digits are no figures.
    figures = lambda c: F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.regexp_replace(c, "ACME-[0-9]+", ""), F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1), lambda x: x.cast("double")), lambda x: ~x.between(1900, 2199) | (x != F.floor(x))))
    scales = lambda x: F.array(x, x * 1e4, x / 1e4, x * 1e8, x / 1e8)
    p = p.withColumn("s", figures("src")).withColumn("g", figures("dst"))
    lacks = lambda a, b: F.size(F.filter(a, lambda x: ~F.arrays_overlap(scales(x), F.col(b))))
    p = p.select("l_orderkey", "l_linenumber", lacks("s", "g").alias("missing"), lacks("g", "s").alias("added"), (~F.contains("dst", "name")).cast("int").alias("tickers_missing"))
    return p.withColumn("score", F.round(F.greatest(F.lit(0.0), 1 - (F.col("missing") + F.col("added") + F.col("tickers_missing")) * 0.12), 2))


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN rule * 0.7::DOUBLE ELSE (rule + quality) / 2::DOUBLE END AS score FROM (SELECT doc_id, n_chars % 11 / 10::DOUBLE AS rule FROM documents) JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)
UNION ALL SELECT doc_id, (n_chars % 11 / 10::DOUBLE) * 0.7::DOUBLE FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def blended_score(spark: SparkSession, d: str) -> DataFrame:
    """The mean of the rules' score and the review's; without a review the rules' alone, at 0.7."""
    review = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    x = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 11 / F.lit(10.0)).alias("rule")).join(review, "doc_id", "left")
    return x.select("doc_id", F.when(F.col("quality").isNull(), F.col("rule") * 0.7).otherwise((F.col("rule") + F.col("quality")) / 2.0).alias("score"))


@query(r"""SELECT page_id, len(l) AS n_issues, array_to_string(l, ',') AS issues FROM (SELECT page_id, list_filter([CASE WHEN length(trim(title)) < 20 THEN 'title_short' END, CASE WHEN length(title) > 60 THEN 'title_long' END, CASE WHEN NOT starts_with(url, 'https://') THEN 'insecure_url' END, CASE WHEN contains(url, '?') THEN 'query_in_url' END, CASE WHEN length(html) < 1500 THEN 'body_short' END, CASE WHEN NOT regexp_matches(html, '<h1[ >]') THEN 'no_heading' END], lambda x: x IS NOT NULL) AS l
FROM (SELECT *, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages))""")
def submission_issues(spark: SparkSession, d: str) -> DataFrame:
    """All that is wrong with a submitted page, in a fixed order."""
    p = table(spark, d, "pages").withColumn("title", F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    rules = [
        (F.length(F.trim("title")) < 20, "title_short"), (F.length("title") > 60, "title_long"), (~F.startswith("url", F.lit("https://")), "insecure_url"),
        (F.contains("url", F.lit("?")), "query_in_url"), (F.length("html") < 1500, "body_short"), (~F.regexp_like("html", F.lit("<h1[ >]")), "no_heading"),
    ]
    p = p.withColumn("l", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in rules])))
    return p.select("page_id", F.size("l").alias("n_issues"), F.array_join("l", ",").alias("issues"))


@query("""WITH a AS (SELECT user_id, CASE WHEN count(*) > 40 AND count(DISTINCT event_type) <= 2 THEN 'bot' WHEN count(*) FILTER (event_type = 'error') * 5 > count(*) THEN 'suspect' ELSE 'human' END AS class, count(*) AS n FROM events GROUP BY 1)
SELECT class, count(*) AS agents, sum(n)::BIGINT AS hits, round(sum(n) * 100.0::DOUBLE / (SELECT sum(n) FROM a), 1) AS share FROM a GROUP BY 1""")
def traffic_quality(spark: SparkSession, d: str) -> DataFrame:
    """Agents by what their traffic looks like, over all agents, with their share of hits."""
    bad, n = F.count_if(F.col("event_type") == "error"), F.count("*")
    kind = F.when((n > 40) & (F.count_distinct("event_type") <= 2), "bot").when(bad * 5 > n, "suspect").otherwise("human")
    a = events(spark, d).groupBy("user_id").agg(kind.alias("class"), n.alias("n"))
    g = a.groupBy("class").agg(F.count("*").alias("agents"), F.sum("n").alias("hits"))
    total = F.sum("hits").over(Window.partitionBy(F.lit(1)))  # three rows
    return g.select("class", "agents", "hits", rate(F.col("hits"), total).alias("share"))


@query("""WITH m AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations) SELECT conv_id, turn, n FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, turn) <= 2""")
def longest_parts(spark: SparkSession, d: str) -> DataFrame:
    """The two longest turns of a conversation, the earlier of equal ones first."""
    m = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return top_per_group(m, ["conv_id"], [F.desc("n"), F.col("turn")], 2).select("conv_id", "turn", "n")
