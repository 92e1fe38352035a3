"""Grounding queries: names in whole texts, answers against questions, targets against their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators.grounding import mentions, supported_claims
from lodestream.plans.base import query
from lodestream.session import table

#: The names looked for are the benchmark's distinct words of this many letters at least.
NAME_LETTERS = 7


def names(spark: SparkSession, d: str) -> list[tuple[str, str, bool]]:
    """Distinct words of the benchmark, a list that does not grow with the texts; :func:`mentions` checks its size."""
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<![a-z0-9_])([a-z]{{{NAME_LETTERS},}})(?![a-z0-9_])"), F.lit(1))).alias("w"))
    return [(r.w, r.w, False) for r in words.distinct().orderBy("w").collect()]


_TOKENS = "list_filter(regexp_split_to_array(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9_]+'), lambda w: w <> '')"
_NAMES = f"names AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda w: regexp_full_match(w, '[a-z]{{{NAME_LETTERS},}}'))) AS w FROM benchmark)"


@query(f"""WITH {_NAMES}, t AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS w FROM documents)
SELECT doc_id, count(DISTINCT w) AS names, count(*) AS mentions FROM t JOIN names USING (w) GROUP BY 1""")
def term_mentions(spark: SparkSession, d: str) -> DataFrame:
    """How many of the benchmark's longer words a document mentions, and how often: one automaton over whole texts."""
    hits = mentions(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text", names(spark, d))
    return hits.groupBy("doc_id").agg(F.count("*").alias("names"), F.sum("n").alias("mentions"))


@query(f"""WITH {_NAMES}, t AS (SELECT conv_id, turn, role, unnest({_TOKENS.format('text')}) AS w FROM conversations), h AS (SELECT DISTINCT conv_id, turn, role, w FROM t JOIN names USING (w)),
asked AS (SELECT DISTINCT conv_id, w FROM h WHERE role <> 'assistant')
SELECT h.conv_id, h.turn, count(*) AS claimed, count(*) FILTER (asked.w IS NULL) AS unsupported, min(h.w) FILTER (asked.w IS NULL) AS first_unsupported
FROM h LEFT JOIN asked ON asked.conv_id = h.conv_id AND asked.w = h.w WHERE role = 'assistant' GROUP BY 1, 2""")
def entity_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Names in an answer that no question of its conversation has: sets of names are joined, conversations are never gathered."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    hits = mentions(rows, ["conv_id", "turn", "role"], "text", names(spark, d)).select("conv_id", "turn", "role", "term").distinct()
    asked = hits.where("role <> 'assistant'").select("conv_id", "term", F.lit(True).alias("asked")).distinct()
    j = hits.where("role = 'assistant'").join(asked, ["conv_id", "term"], "left")
    lost = F.col("asked").isNull()
    return j.groupBy("conv_id", "turn").agg(F.count("*").alias("claimed"), F.count_if(lost).alias("unsupported"), F.min(F.when(lost, F.col("term"))).alias("first_unsupported"))




@query(f"""WITH s AS (SELECT p_partkey, p_size % 4 AS kind, p_retailprice FROM part), c AS (
  SELECT CASE WHEN l_linenumber = 1 THEN 'forecast_horizon_missing' WHEN l_linenumber = 2 AND kind IN (0, 2) OR l_linenumber > 2 AND kind = 1 THEN 'forecast_horizon_unsupported' WHEN l_quantity < 10 OR kind = 3 THEN 'forecast_target_unsupported' WHEN kind = 2 THEN 'forecast_unit_missing' WHEN kind = 1 THEN 'forecast_unit_unsupported' ELSE 'supported' END AS outcome
  FROM lineitem JOIN s ON l_partkey = p_partkey)
SELECT outcome, count(*) AS claims FROM c GROUP BY 1""")
def target_support(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of claims about targets: parts state one (or none), line items claim it, some with another value, horizon or none."""
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    kind = F.col("p_size") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("Price target for "), "p_name", F.lit(" raised to $"), price, F.lit(" by 2027.")))
        .when(kind == 1, F.concat(F.lit("Our forecast is €"), price, F.lit(" in 12 months.")))
        .when(kind == 2, F.concat(F.lit("The 2027 target is "), price, F.lit(".")))
        .otherwise(F.concat(F.lit("No view on "), "p_name", F.lit(" for 2027 or in 12 months.")))
    )
    part = table(spark, d, "part").select("p_partkey", "p_retailprice", text.alias("source"))
    horizon = F.when(F.col("l_linenumber") == 1, F.lit(None)).when(F.col("l_linenumber") == 2, F.lit("12 months")).otherwise(F.lit("year-end 2027"))
    other = F.coalesce(F.col("l_quantity") < 10, F.lit(False))
    # Equal claims about a part are judged once: at most six, whatever the number of lines.
    line = table(spark, d, "lineitem").groupBy("l_partkey", horizon.alias("horizon"), other.alias("other")).agg(F.count("*").alias("n"))
    claims = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").cast("string").alias("ticker"), F.when(F.col("other"), F.col("p_retailprice") + 7).otherwise(F.col("p_retailprice")).alias("target"),
        F.lit(None).cast("double").alias("previous_target"), "horizon", "source", "n")
    outcome = F.coalesce(F.get("issues", F.lit(0))["code"], F.lit("supported"))
    return supported_claims(claims).groupBy(outcome.alias("outcome")).agg(F.sum("n").alias("claims"))
