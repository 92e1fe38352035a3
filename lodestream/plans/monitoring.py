"""Monitoring rules over the consensus, the revisions and the policy statements of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators.alerts import CONSENSUS, consensus_hits, policy_hits, revision_hits
from lodestream.plans import consensus, macro, texts
from lodestream.plans.base import SQL, query

#: Thresholds of the rules that every asset has.
BOUNDS = dict(zip(CONSENSUS, (50.0, 45.0, 5.0, 5.0), strict=True))


@query(f"""WITH c AS ({SQL['consensus_deltas']}), k(kind, bound) AS (VALUES {', '.join(f"('{k}', {b}::DOUBLE)" for k, b in BOUNDS.items())}), r AS ({SQL['revision_decision']}), p AS ({SQL['policy_statement']})
SELECT kind, asset AS target, score::DOUBLE AS score FROM c, k WHERE CASE kind WHEN 'CONSENSUS_ABOVE' THEN score >= bound WHEN 'CONSENSUS_BELOW' THEN score <= bound WHEN 'CONSENSUS_DROP_24H' THEN d1 <= -bound ELSE d1 >= bound END
UNION ALL SELECT 'MACRO_REVISION', max_by(period || '/' || vintage, (vintage, revision_no)), NULL FROM r WHERE revision_no > 0
UNION ALL SELECT 'CENTRAL_BANK_DECISION', max(day), NULL FROM (SELECT * FROM p ORDER BY day DESC LIMIT 20) WHERE decision <> 'OTHER'""")
def monitoring_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rules that fire: four for each asset's consensus, one for revisions, one for the board's decisions."""
    state = consensus.consensus_deltas(spark, d).select("asset", "score", F.col("d1").alias("change"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(b).alias("threshold")) for k, b in BOUNDS.items()])).alias("k")
    own = state.select("asset", kinds).select(F.xxhash64("asset", "k.kind").alias("rule_id"), "k.kind", F.lit("asset").alias("scope"), F.col("asset").alias("ref"), "k.threshold")
    other = spark.createDataFrame([(1, "MACRO_REVISION", "macro_indicator", "orders", None), (2, "CENTRAL_BANK_DECISION", "central_bank", "board", None)], "rule_id long, kind string, scope string, ref string, threshold double")
    revised = macro.revision_decision(spark, d).select(F.lit("orders").alias("indicator"), F.concat("period", F.lit("/"), "vintage").alias("observation_id"), "vintage", "revision_no", "value")
    said = texts.policy_statement(spark, d).select(F.lit("board").alias("bank"), F.col("day").alias("document_id"), F.col("day").alias("published_at"), "decision", F.lit(None).cast("string").alias("stance"), "change_bps")
    hits = consensus_hits(own, state).unionByName(revision_hits(other, revised)).unionByName(policy_hits(other, said))
    return hits.select("kind", "target", "score")
