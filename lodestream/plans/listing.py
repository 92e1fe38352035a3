"""Listings over the relational tables: predicates, joins, facets, pages, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.operators.relational import day_spine, keyset_page, top_per_group
from lodestream.plans.base import query
from lodestream.session import dealt, table


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))


@query("SELECT c_custkey, c_name, c_mktsegment, round(c_acctbal, 2) AS c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 0 AND 5000 AND NOT (c_name LIKE '%7' OR c_nationkey = 3) AND c_name LIKE 'Customer%'")
def predicate_set(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    keep = F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_acctbal").between(0, 5000) & ~(F.col("c_name").endswith("7") | (F.col("c_nationkey") == 3)) & F.col("c_name").startswith("Customer")
    return c.where(keep).select("c_custkey", "c_name", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 32")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderkey = 32").select("o_orderkey", "o_custkey", "o_orderstatus").limit(1)


@query("SELECT c_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY 1")
def first_match_by_order(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    return o.join(table(spark, d, "customer").select("c_custkey"), "c_custkey", "left_semi")


@query("""SELECT n_name AS nation, r_name AS region, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""")
def inner_chain(spark: SparkSession, d: str) -> DataFrame:
    """Line items pre-aggregated by supplier before the dimensions join, so the fact table shuffles once and narrow."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return li.join(s, "s_suppkey").join(n, "n_nationkey").groupBy("nation", "region").agg(F.sum("n").alias("n"), F.round(F.sum("rev"), 2).alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(array_to_string(list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderkey IS NOT NULL), ','), '') AS order_keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def left_nested(spark: SparkSession, d: str) -> DataFrame:
    """Parents with their children as an ordered list, parents without any included."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("o_orderkey")).alias("l"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select(
        "c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce(F.concat_ws(",", F.transform("l", lambda x: x.cast("string"))), F.lit("")).alias("order_keys"))


@query("SELECT d.doc_id, source, n_chars FROM documents d WHERE n_chars > 0 AND text IS NOT NULL AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)")
def publication_ready_semi(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("n_chars > 0 AND text IS NOT NULL").select("doc_id", "source", "n_chars")
    l = table(spark, d, "labels")
    return docs.join(l.where("quality = 1").select("doc_id"), "doc_id", "left_semi").join(l.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def pending_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size IN (1, 7, 15)) AND l_suppkey IN (SELECT s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey IN (1, 2)) AND l_returnflag IN ('A', 'R')""")
def facet_filter_and_or(spark: SparkSession, d: str) -> DataFrame:
    """Any value within a facet, all facets together: one semi join per facet."""
    p = table(spark, d, "part").where(F.col("p_size").isin(1, 7, 15)).select(F.col("p_partkey").alias("l_partkey"))
    n = table(spark, d, "nation").where(F.col("n_regionkey").isin(1, 2)).select(F.col("n_nationkey").alias("s_nationkey"))
    s = table(spark, d, "supplier").join(n, "s_nationkey", "left_semi").select(F.col("s_suppkey").alias("l_suppkey"))
    li = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "R")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return li.join(p, "l_partkey", "left_semi").join(s, "l_suppkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE false")
def invalid_facet_matches_nothing(spark: SparkSession, d: str) -> DataFrame:
    """An unknown facet value matches nothing; it is not ignored."""
    known = {"F", "O", "P"}
    asked = "X"
    return table(spark, d, "orders").where(F.col("o_orderstatus") == asked if asked in known else F.lit(False)).select("o_orderkey")


@query("""SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place, count(*) OVER () > 25 AS has_more FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1998-06-01', 9000) QUALIFY place <= 25""")
def keyset_page_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"), "o_orderkey")
    import datetime

    after = [datetime.datetime(1998, 6, 1, tzinfo=datetime.timezone.utc), 9000]
    return keyset_page(o, ["ts", "o_orderkey"], after, 25).select("o_orderkey", F.to_date("ts").cast("string").alias("day"), F.col("place").cast("long").alias("place"), "has_more")


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def offset_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority").orderBy("o_orderkey").offset(40).limit(20)


@query("""SELECT o_orderkey, o_orderpriority = '1-URGENT' AS featured, least(o_orderdate::DATE + (o_orderkey % 5)::INT, o_orderdate::DATE + 3)::VARCHAR AS shown FROM orders ORDER BY featured DESC, least(o_orderdate::DATE + (o_orderkey % 5)::INT, o_orderdate::DATE + 3) DESC, o_orderkey LIMIT 40""")
def featured_then_recency(spark: SparkSession, d: str) -> DataFrame:
    """Featured rows first, then by display date, which is capped."""
    shown = F.least(F.date_add("day", (F.col("o_orderkey") % 5).cast("int")), F.date_add("day", 3))
    o = orders(spark, d).select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("featured"), shown.alias("s"))
    return o.orderBy(F.desc("featured"), F.desc("s"), "o_orderkey").limit(40).select("o_orderkey", "featured", F.col("s").cast("string").alias("shown"))


@query("SELECT source, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 5")
def most_active_topk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest")).orderBy(F.desc("n"), "source").limit(5)


@query("SELECT doc_id, source, n_chars FROM documents WHERE n_chars > 500 QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1")
def diverse_one_per_source(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("n_chars > 500")
    return docs.groupBy("source").agg(F.max_by(F.struct("doc_id", "n_chars"), F.struct("n_chars", (-F.col("doc_id")).alias("i"))).alias("r")).select("r.doc_id", "source", "r.n_chars")


@query("SELECT doc_id, source, n_chars FROM (SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 2) ORDER BY n_chars DESC, doc_id LIMIT 15")
def cap_two_per_group(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return top_per_group(docs, ["source"], [F.desc("n_chars"), F.col("doc_id")], 2).drop("rank").orderBy(F.desc("n_chars"), "doc_id").limit(15)


@query("""WITH t AS (SELECT p_partkey, p_brand, p_size, CASE WHEN p_size >= 45 THEN 0 ELSE 1 END AS tier FROM part WHERE p_brand = 'Brand#13'),
r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY p_size DESC, p_partkey) AS k FROM t) SELECT p_partkey, p_size, tier::INT AS tier FROM r WHERE tier = 1 OR k <= 6 ORDER BY tier, k LIMIT 9""")
def two_tier_fill(spark: SparkSession, d: str) -> DataFrame:
    """Up to six of the first tier, then the others up to nine in all."""
    t = table(spark, d, "part").where("p_brand = 'Brand#13'").select("p_partkey", "p_size", F.when(F.col("p_size") >= 45, 0).otherwise(1).alias("tier"))
    r = top_per_group(t, ["tier"], [F.desc("p_size"), F.col("p_partkey")], 9)
    return r.where("tier = 1 OR rank <= 6").orderBy("tier", "rank").limit(9).select("p_partkey", "p_size", "tier")


@query("""WITH ids(pos, k) AS (VALUES (0, 33), (1, 1), (2, 999999999), (3, 7), (4, 2)) SELECT pos, o_orderkey, o_orderstatus FROM ids JOIN orders ON o_orderkey = k""")
def order_preserving_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Rows for a list of ids in its order; missing ones drop out."""
    ids = spark.createDataFrame([([33, 1, 999999999, 7, 2],)], "ids array<long>").select(F.posexplode("ids").alias("pos", "o_orderkey"))
    return ids.join(table(spark, d, "orders"), "o_orderkey").select("pos", "o_orderkey", "o_orderstatus")


@query("""SELECT event_id, coalesce(c_name, s_name) AS name, CASE WHEN c_name IS NOT NULL THEN 'customer' WHEN s_name IS NOT NULL THEN 'supplier' END AS kind FROM events LEFT JOIN customer ON event_type = 'purchase' AND c_custkey = user_id LEFT JOIN supplier ON event_type <> 'purchase' AND s_suppkey = user_id""")
def polymorphic_target(spark: SparkSession, d: str) -> DataFrame:
    """A target id that names a customer or a supplier depending on the row's type."""
    e = table(spark, d, "events").select("event_id", "event_type", "user_id")  # split by type: null keys of a join would meet in one task
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("c"), "c_name")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("s"), "s_name")
    to = lambda rows, names, key, name, kind: rows.join(names, F.col("user_id") == F.col(key), "left").select("event_id", F.col(name).alias("name"), F.when(F.col(name).isNotNull(), kind).alias("kind"))
    bought = F.coalesce(F.col("event_type") == "purchase", F.lit(False))
    return to(e.where(bought), c, "c", "c_name", "customer").union(to(e.where(~bought), s, "s", "s_name", "supplier"))


@query("""SELECT a.l_partkey AS partkey, a.l_suppkey AS suppkey, b.l_suppkey AS peer FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) a JOIN (SELECT l_partkey, l_suppkey, max(l_shipdate) AS t FROM lineitem GROUP BY ALL) b ON a.l_partkey = b.l_partkey AND a.l_suppkey <> b.l_suppkey
QUALIFY row_number() OVER (PARTITION BY a.l_partkey, a.l_suppkey ORDER BY t DESC, b.l_suppkey) <= 3""")
def same_asset_peers(spark: SparkSession, d: str) -> DataFrame:
    """The three newest peers of each supplier of a part, itself left out.

    The newest four suppliers of a part hold them for everyone, so no pair of all suppliers of a part is made.
    """
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate")
    last = dealt(lines, lines, "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.max("l_shipdate").alias("t"))
    last = dealt(last, lines, "l_partkey")  # windows and join stay in these parts
    top = top_per_group(last, ["l_partkey"], [F.desc("t"), F.col("l_suppkey")], 4, "r").select("l_partkey", F.col("l_suppkey").alias("peer"), "t")
    pairs = last.select("l_partkey", "l_suppkey").join(top, "l_partkey").where("l_suppkey <> peer")
    return top_per_group(pairs, ["l_partkey", "l_suppkey"], [F.desc("t"), F.col("peer")], 3).select(F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"), "peer")


@query("""SELECT p_brand AS brand, s_nationkey AS nation, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2""")
def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    return li.join(p, "l_partkey").join(s, "l_suppkey").groupBy("brand", "nation").agg(F.sum("n").alias("n"))


@query("""WITH c AS (SELECT o_orderdate::DATE AS day, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), s AS (SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE, INTERVAL 1 DAY))::DATE AS day FROM orders)
SELECT day::VARCHAR AS day, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM s LEFT JOIN c USING (day)""")
def date_spine_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    c = o.where("o_orderpriority = '1-URGENT'").groupBy("day").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return day_spine(o, "day").join(c, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query("""SELECT n_nationkey, n_name, count(*) FILTER (c_acctbal > 0) AS good, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2 HAVING count(*) FILTER (c_acctbal > 0) >= 1""")
def filtered_child_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count_if(F.col("c_acctbal") > 0).alias("good"), F.count("*").alias("customers")).where("good >= 1")
    return c.join(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")


@query("""SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'F') THEN 'succeeded' WHEN bool_or(l_returnflag = 'N' AND l_linestatus = 'O') THEN 'in flight' WHEN bool_or(l_linestatus = 'F') THEN 'partly' ELSE 'failed' END AS status FROM lineitem GROUP BY 1""")
def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    done = F.col("l_linestatus") == "F"
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(done).alias("all_"), F.bool_or(F.expr("l_returnflag = 'N' AND l_linestatus = 'O'")).alias("fly"), F.bool_or(done).alias("any_"))
    return g.select("l_orderkey", F.when(F.col("all_"), "succeeded").when(F.col("fly"), "in flight").when(F.col("any_"), "partly").otherwise("failed").alias("status"))


@query("""SELECT 'only_orders' AS side, o_custkey AS custkey FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'only_customers', c_custkey FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def parity_except(spark: SparkSession, d: str) -> DataFrame:
    """What one side has and the other lacks, both ways."""
    a = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("custkey")).distinct()
    b = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"))
    return a.join(b, "custkey", "left_anti").select(F.lit("only_orders").alias("side"), "custkey").union(b.join(a, "custkey", "left_anti").select(F.lit("only_customers").alias("side"), "custkey"))


@query("""SELECT kind, key, label FROM (SELECT 'customer' AS kind, c_custkey AS key, c_name AS label FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation) WHERE label LIKE '%1'""")
def heterogeneous_union(spark: SparkSession, d: str) -> DataFrame:
    part = lambda n, k, l: table(spark, d, n).select(F.lit(n).alias("kind"), F.col(k).cast("long").alias("key"), F.col(l).alias("label"))  # noqa: E731,E741
    return part("customer", "c_custkey", "c_name").unionByName(part("supplier", "s_suppkey", "s_name")).unionByName(part("nation", "n_nationkey", "n_name")).where("label LIKE '%1'")


@query("""SELECT o_custkey AS custkey, min(k)::BIGINT AS free_seat FROM (SELECT DISTINCT o_custkey FROM orders), range(1, 13) r(k) WHERE (o_custkey, k) NOT IN (SELECT o_custkey, 1 + o_orderkey % 12 FROM orders) GROUP BY 1""")
def smallest_free_seat(spark: SparkSession, d: str) -> DataFrame:
    """The smallest unused number up to 12 per customer."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set((1 + F.col("o_orderkey") % 12).cast("int")).alias("taken"))  # 12 values at most
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(12)), "taken"))
    return o.select(F.col("o_custkey").alias("custkey"), free.cast("long").alias("free_seat")).where("free_seat IS NOT NULL")


@query("""WITH x(code, alias) AS (VALUES ('us', 'USA'), ('us', 'U.S.'), ('uk', 'Britain'), ('gb', 'britain '), ('de', 'Germany'), ('us', 'usa'), ('fr', 'France'), ('fx', 'FRANCE'))
SELECT norm, count(DISTINCT code) AS codes FROM (SELECT code, regexp_replace(lower(alias), '[^a-z0-9]+', '', 'g') AS norm FROM x UNION ALL SELECT n_nationkey::VARCHAR, regexp_replace(lower(n_name), '[^a-z0-9]+', '', 'g') FROM nation) GROUP BY 1 HAVING count(DISTINCT code) > 1""")
def alias_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Aliases that, normalised, name more than one key; a given list beside the nations."""
    x = spark.createDataFrame([("us", "USA"), ("us", "U.S."), ("uk", "Britain"), ("gb", "britain "), ("de", "Germany"), ("us", "usa"), ("fr", "France"), ("fx", "FRANCE")], "code string, alias string")
    x = x.union(table(spark, d, "nation").select(F.col("n_nationkey").cast("string"), "n_name"))
    return x.groupBy(F.regexp_replace(F.lower("alias"), "[^a-z0-9]+", "").alias("norm")).agg(F.count_distinct("code").alias("codes")).where("codes > 1")


@query("""SELECT o_orderkey, o_custkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 2000 AS shard FROM orders""")
def sitemap_shards(spark: SparkSession, d: str) -> DataFrame:
    """Shards of 2,000 rows in key order: counts of key ranges on two levels first, then numbers inside ranges, so no task sorts all rows."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").withColumn("range_", F.floor(F.col("o_orderkey") / 4096))
    per = o.groupBy("range_").agg(F.count("*").alias("c")).withColumn("block", F.floor(F.col("range_") / 4096))
    blocks = per.groupBy("block").agg(F.sum("c").alias("b"))
    blocks = blocks.select("block", F.sum("b").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("b0"))  # a row per 16.7 million keys
    inside = F.sum("c").over(Window.partitionBy("block").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    before = per.withColumn("c0", inside).join(blocks, "block").select("range_", (F.coalesce("b0", F.lit(0)) + F.coalesce("c0", F.lit(0))).alias("before"))
    w = Window.partitionBy("range_").orderBy("o_orderkey")
    rows = o.join(before, "range_").withColumn("rn", F.coalesce("before", F.lit(0)) + F.row_number().over(w) - 1)
    return rows.select("o_orderkey", "o_custkey", F.floor(F.col("rn") / 2000).cast("long").alias("shard"))


@query("""WITH p AS (SELECT doc_id, source, lang, n_chars, CASE WHEN lang <> 'en' THEN 0 WHEN n_chars > 8000 THEN 1 WHEN source = 'src0' THEN 2 ELSE 3 END AS tier FROM documents) SELECT doc_id, tier::INT AS tier FROM p QUALIFY row_number() OVER (PARTITION BY tier ORDER BY md5(doc_id::VARCHAR), doc_id) <= 10""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Ten of each stratum, chosen by a hash of the id, so that every run chooses the same."""
    tier = F.when(F.col("lang") != "en", 0).when(F.col("n_chars") > 8000, 1).when(F.col("source") == "src0", 2).otherwise(3)
    p = table(spark, d, "documents").select("doc_id", tier.alias("tier"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    return top_per_group(p, ["tier"], [F.col("h"), F.col("doc_id")], 10).select("doc_id", "tier")


@query("""SELECT o_orderkey, o_custkey, coalesce(o_custkey, first_value(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey)) AS owner, o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS known,
coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END, first_value(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS filled FROM orders""")
def identity_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Missing owners taken from other rows of the same visitor."""
    known = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey"))
    o = table(spark, d, "orders").withColumn("known", known)
    own = o.where("known IS NOT NULL").groupBy("o_custkey").agg(F.min_by("known", "o_orderkey").alias("first_known"))
    return o.join(own, "o_custkey", "left").select("o_orderkey", "o_custkey", F.col("o_custkey").alias("owner"), "o_orderpriority", "known", F.coalesce("known", "first_known").alias("filled"))
