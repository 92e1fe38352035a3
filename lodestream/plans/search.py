"""Field-weighted search, and classification of items by what is said about them."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.scalar import clamp_confidence
from lodestream.operators.search import normal_form, ranked_search
from lodestream.plans.base import query
from lodestream.session import dealt, table


@query(r"""SELECT doc_id, md5(trim(regexp_replace(replace(lower(strip_accents(text)), '&', ' and '), '[^\p{L}\p{N}]+', ' ', 'g'))) AS key FROM documents""")
def search_normal_form(spark: SparkSession, d: str) -> DataFrame:
    """The hash of each whole text in the normal form that search compares."""
    return table(spark, d, "documents").select("doc_id", F.md5(normal_form(F.col("text"))).alias("key"))


def _sql_score(x: str, q: str) -> str:
    """The score ladder for a text column in DuckDB."""
    tight, pairs = q.replace(" ", ""), Counter(q.replace(" ", "")[i : i + 2] for i in range(len(q.replace(" ", "")) - 1))

    def term(t: str) -> str:
        most = 1 if len(t) <= 5 else 2
        close = f"WHEN len(w) >= 3 AND abs(len(w) - {len(t)}) <= {most} AND levenshtein(w, '{t}') <= {most} THEN 30 - levenshtein(w, '{t}') * 6" if len(t) >= 3 else ""
        return f"list_max([CASE WHEN w = '{t}' THEN 48 WHEN starts_with(w, '{t}') OR (len(w) >= 3 AND starts_with('{t}', w)) THEN 40 WHEN contains(w, '{t}') THEN 32 {close} ELSE 0 END FOR w IN string_split({x}, ' ')])"

    c = f"replace({x}, ' ', '')"
    grams = f"[substr({c}, i, 2) FOR i IN range(1, len({c}))]"
    common = " + ".join(f"least({n}, len(list_filter({grams}, lambda g: g = '{p}')))" for p, n in sorted(pairs.items()))
    dice = f"(CASE WHEN len({c}) BETWEEN 2 AND 240 THEN 2.0::DOUBLE * ({common}) / (len({c}) - 1 + {sum(pairs.values())}) ELSE 0 END)"
    terms = [term(t) for t in q.split(" ")]
    return (
        f"CASE WHEN coalesce({x}, '') = '' THEN 0 WHEN {x} = '{q}' THEN 160 WHEN starts_with({x}, '{q}') THEN 125 WHEN contains({x}, '{q}') THEN 105 WHEN contains({c}, '{tight}') THEN 95 "
        f"WHEN {' AND '.join(t + ' > 0' for t in terms)} THEN ({' + '.join(terms)}) / {float(len(terms))}::DOUBLE WHEN {dice} >= 0.45 THEN {dice} * 36 ELSE 0 END"
    )


ASKED = ["widgte", "small brand", "promo cold widget", "sml wdgt", "burnished"]


def _sql_search(n: int, q: str) -> str:
    passes = "true"
    if len(q) >= 4 and q.isalnum():
        parts = [q[i : i + 3] for i in range(len(q) - 2)]
        passes = " + ".join(f"contains(every, '{p}')::INT" for p in parts) + f" >= {-(-len(parts) // 2)}"
    best = f"greatest(({_sql_score('a', q)}) * 4::DOUBLE, ({_sql_score('b', q)}) * 3.4::DOUBLE, ({_sql_score('c', q)}) * 2::DOUBLE, ({_sql_score('every', q)}) * 1.35::DOUBLE)"
    return f"SELECT {n} AS asked, p_partkey, round(score, 4) AS score FROM (SELECT p_partkey, CASE WHEN {passes} THEN {best} * CASE WHEN p_size < 10 THEN 1.2::DOUBLE ELSE 1 END ELSE 0 END AS score FROM f) WHERE score >= 18 QUALIFY row_number() OVER (ORDER BY score DESC, p_partkey) <= 12"


@query(r"WITH n AS (SELECT p_partkey, p_size, " + ", ".join(rf"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS {x}" for c, x in (("p_name", "a"), ("p_brand", "b"), ("p_type", "c"))) + "), f AS (SELECT *, a || ' ' || b || ' ' || c AS every FROM n) ".replace("), f", " FROM part), f")
       + " UNION ALL ".join(f"({_sql_search(n, q)})" for n, q in enumerate(ASKED)))
def search_field_weights(spark: SparkSession, d: str) -> DataFrame:
    """The twelve best of each asked query: names count four times, aliases 3.4, kinds twice, all together 1.35; small ones a fifth more; under 18 none."""
    names = [normal_form(F.col(c), ascii_only=True).alias(x) for c, x in (("p_name", "a"), ("p_brand", "b"), ("p_type", "c"))]
    f = table(spark, d, "part").select("p_partkey", "p_size", *names)
    every = F.concat_ws(" ", "a", "b", "c")
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("weight"), t.alias("text")) for t, w in ((F.col("a"), 4.0), (F.col("b"), 3.4), (F.col("c"), 2.0), (every, 1.35))])).alias("f")
    fields = f.select(F.col("p_partkey").alias("item"), F.when(F.col("p_size") < 10, 1.2).otherwise(1.0).alias("boost"), each).select("item", "boost", "f.*")
    return ranked_search(fields, ASKED).select("asked", F.col("item").alias("p_partkey"), F.round("score", 4).alias("score"))


@query("""WITH place AS (SELECT o_orderkey AS item, CASE WHEN o_custkey % 7 <> 0 THEN n_regionkey END AS region FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
line AS (SELECT l_orderkey AS item, l_suppkey, CASE WHEN l_suppkey % 9 <> 0 THEN n_regionkey END AS region, CASE WHEN s_acctbal > 0 THEN n_regionkey END AS seat, l_linenumber = 1 AS main, CASE WHEN l_tax = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, l_discount * 15) END AS sure FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
inst AS (SELECT item, l_suppkey, bool_or(main) AS main, max(sure) AS sure, any_value(seat) AS seat FROM line GROUP BY ALL),
said AS (SELECT item, region, true AS main FROM place WHERE region IS NOT NULL UNION SELECT item, region, false FROM line WHERE region IS NOT NULL UNION SELECT item, seat, main FROM inst WHERE seat IS NOT NULL),
g AS (SELECT item, list_sort(list(DISTINCT region) FILTER (main)) AS p, list_sort(list(DISTINCT region)) AS every FROM said GROUP BY 1),
n AS (SELECT item, count(*) AS lines, count(region) AS placed FROM line GROUP BY 1), i AS (SELECT item, count(*) AS institutions, max(sure) AS surest FROM inst GROUP BY 1),
x AS (SELECT place.item, CASE place.item % 17 WHEN 0 THEN 'GLOBAL' WHEN 1 THEN 'MULTIPLE' WHEN 2 THEN 'NONE' END AS told, coalesce(p, []) AS p, coalesce(every, []) AS every, coalesce(institutions, 0) AS institutions, surest, place.region IS NOT NULL AS here, coalesce(lines, 0) AS lines, coalesce(placed, 0) AS placed FROM place LEFT JOIN g USING (item) LEFT JOIN n USING (item) LEFT JOIN i USING (item)),
s AS (SELECT *, CASE WHEN told IN ('GLOBAL', 'NONE') THEN told WHEN told = 'MULTIPLE' OR len(p) > 1 OR (len(p) = 0 AND len(every) > 1) THEN 'MULTIPLE' WHEN len(every) >= 1 THEN 'KNOWN' ELSE 'UNKNOWN' END AS state FROM x)
SELECT item, state, CASE WHEN state = 'KNOWN' THEN CASE WHEN len(p) = 1 THEN p[1] ELSE every[1] END END AS primary_region, array_to_string(CASE WHEN state = 'MULTIPLE' THEN every WHEN state = 'KNOWN' THEN list_filter(every, lambda r: r <> CASE WHEN len(p) = 1 THEN p[1] ELSE every[1] END) ELSE [] END, ',') AS related,
institutions, surest, round(((told IS NOT NULL)::INT + here::INT + placed + lines) / ((told IS NOT NULL)::INT + 1 + 2 * lines)::DOUBLE, 6) AS confidence FROM s""")
def classification(spark: SparkSession, d: str) -> DataFrame:
    """Items with a jurisdiction state, primary and related regions, institutions and the share of what was said that could be resolved.

    An institution named as primary anywhere is primary, with its surest mention, and brings its own region. A told
    state of GLOBAL or NONE holds; several primary regions, or several related ones and no primary, are MULTIPLE.
    """
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")).join(nation, "n_nationkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    place = dealt(orders, orders, "o_custkey").join(customer, "o_custkey").select(F.col("o_orderkey").alias("item"), F.when(F.col("o_custkey") % 7 != 0, F.col("n_regionkey")).alias("home"))
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"), "s_acctbal").join(nation, "n_nationkey")
    sure = clamp_confidence(F.when(F.col("l_tax") != 0, F.col("l_discount") * 15))
    lines = table(spark, d, "lineitem")
    line = lines.join(supplier, "l_suppkey").select(
        F.col("l_orderkey").alias("item"), "l_suppkey", F.when(F.col("l_suppkey") % 9 != 0, F.col("n_regionkey")).alias("region"),
        F.when(F.col("s_acctbal") > 0, F.col("n_regionkey")).alias("seat"), (F.col("l_linenumber") == 1).alias("main"), sure.alias("sure"),
    )
    inst = dealt(line, lines, "item", "l_suppkey").groupBy("item", "l_suppkey").agg(F.bool_or("main").alias("main"), F.max("sure").alias("sure"), F.first("seat").alias("seat"), F.count("*").alias("lines"), F.count("region").alias("placed"), F.max("region").alias("region"))
    # At most five regions a set.
    per = dealt(inst, lines, "item").groupBy("item").agg(
        F.count("*").alias("institutions"), F.max("sure").alias("surest"), F.sum("lines").alias("lines"), F.sum("placed").alias("placed"),
        F.collect_set(F.when(F.col("main"), F.col("seat"))).alias("main_seats"), F.collect_set("seat").alias("seats"), F.collect_set("region").alias("regions"),
    )
    none = F.array().cast("array<int>")
    x = place.join(per, "item", "left")
    home = F.when(F.col("home").isNull(), none).otherwise(F.array("home"))
    x = x.withColumn("p", F.array_distinct(F.concat(home, F.coalesce("main_seats", none))))
    x = x.withColumn("every", F.sort_array(F.array_distinct(F.concat("p", F.coalesce("seats", none), F.coalesce("regions", none)))))
    told = F.when(F.col("item") % 17 == 0, "GLOBAL").when(F.col("item") % 17 == 1, "MULTIPLE").when(F.col("item") % 17 == 2, "NONE")
    n_p, n_all = F.size("p"), F.size("every")
    state = (
        F.when(F.col("told").isin("GLOBAL", "NONE"), F.col("told")).when((F.col("told") == "MULTIPLE") | (n_p > 1) | ((n_p == 0) & (n_all > 1)), "MULTIPLE")
        .when(n_all >= 1, "KNOWN").otherwise("UNKNOWN")
    )
    x = x.withColumn("told", told).withColumn("state", state)
    x = x.withColumn("primary_region", F.when(F.col("state") == "KNOWN", F.when(n_p == 1, F.get("p", F.lit(0))).otherwise(F.get("every", F.lit(0)))))
    related = F.when(F.col("state") == "MULTIPLE", F.col("every")).when(F.col("state") == "KNOWN", F.array_remove("every", F.col("primary_region"))).otherwise(none)
    lines, said = F.coalesce("lines", F.lit(0)), F.col("told").isNotNull().cast("int")
    part = said + F.col("home").isNotNull().cast("int") + F.coalesce("placed", F.lit(0)) + lines
    return x.select(
        "item", "state", "primary_region", F.array_join(related.cast("array<string>"), ",").alias("related"), F.coalesce("institutions", F.lit(0)).alias("institutions"), "surest",
        F.round(part / (said + 1 + 2 * lines).cast("double"), 6).alias("confidence"),
    )
