"""Monitoring rules evaluated over the state of what they watch.

A rule (rule_id, kind, scope, ref, threshold) names a kind and what it watches.
Each kind is a join of its rules with the newest state of that thing, so all
rules of all kinds take one pass over each state table, however many rules there
are. A rule that fires gives a hit (rule_id, kind, target, score, message);
whether it is reported again is for the dedupe of alerts to say. A rule with an
unknown kind, a null reference or no state never fires.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.relational import latest_per_key

CONSENSUS = ["CONSENSUS_ABOVE", "CONSENSUS_BELOW", "CONSENSUS_DROP_24H", "CONSENSUS_RISE_24H"]
RELEASES = ["MACRO_RELEASE", "MACRO_SURPRISE_ABOVE", "MACRO_SURPRISE_BELOW"]
POLICY = ["CENTRAL_BANK_DECISION", "POLICY_STANCE_CHANGE"]


def _hit(rows: DataFrame, target: Column, score: Column, message: Column) -> DataFrame:
    return rows.select("rule_id", "kind", target.cast("string").alias("target"), score.cast("double").alias("score"), message.alias("message"))


def consensus_hits(rules: DataFrame, consensus: DataFrame) -> DataFrame:
    """``consensus(asset, score, change)``: a score at or beyond the threshold, or a change within a day of at least as much."""
    j = rules.where(F.col("kind").isin(CONSENSUS)).join(consensus, F.col("ref") == F.col("asset"))
    kind, t = F.col("kind"), F.col("threshold")
    met = F.when(kind == "CONSENSUS_ABOVE", F.col("score") >= t).when(kind == "CONSENSUS_BELOW", F.col("score") <= t).when(kind == "CONSENSUS_DROP_24H", F.col("change") <= -t).otherwise(F.col("change") >= t)
    moved = F.when(F.col("change").isNull(), "").otherwise(F.concat(F.lit(" (24h "), F.when(F.col("change") > 0, "+").otherwise("-"), F.abs("change").cast("string"), F.lit(")")))
    return _hit(j.where(met), F.col("asset"), F.col("score"), F.concat("asset", F.lit(" consensus "), F.col("score").cast("string"), moved))


def release_hits(rules: DataFrame, releases: DataFrame) -> DataFrame:
    """``releases(release_id, family, indicator, title, released_at, surprise_pct, licensed)``, a row a value.

    The newest release that a rule watches counts (by family, or by indicator); a surprise (a share) must be licensed and
    at or beyond the threshold in per cent. Of several such values of a release the first indicator speaks.
    """
    out = releases.where("released_at IS NOT NULL")
    watched = rules.where(F.col("kind").isin(RELEASES)).select("rule_id", "kind", "threshold", "ref", "scope")
    refs = watched.select("scope", "ref").distinct()
    values = out.select("*", F.explode(F.array(F.struct(F.lit("macro_release_family").alias("scope"), F.col("family").alias("ref")), F.struct(F.lit("macro_indicator").alias("scope"), F.col("indicator").alias("ref")))).alias("w")).select(*out.columns, "w.scope", "w.ref")
    values = values.join(refs, ["scope", "ref"], "left_semi")
    newest = values.groupBy("scope", "ref").agg(F.max(F.struct("released_at", "release_id")).alias("last"))
    last = values.join(newest, ["scope", "ref"]).where("release_id = last.release_id")
    j = watched.join(last, ["scope", "ref"])
    percent = F.round(F.col("surprise_pct") * 100, 2)
    beyond = F.when(F.col("kind") == "MACRO_SURPRISE_ABOVE", F.col("surprise_pct") * 100 >= F.col("threshold")).otherwise(F.col("surprise_pct") * 100 <= F.col("threshold"))
    fires = F.when(F.col("kind") == "MACRO_RELEASE", F.lit(True)).otherwise(F.col("licensed") & F.coalesce(beyond, F.lit(False)))
    said = F.when(F.col("kind") == "MACRO_RELEASE", F.concat("title", F.lit(" released"))).otherwise(F.concat("indicator", F.lit(" surprise "), percent.cast("string"), F.lit("%")))
    one = j.where(fires).groupBy("rule_id", "kind", "release_id").agg(F.min_by(said, "indicator").alias("message"))
    return _hit(one, F.col("release_id"), F.lit(None), F.col("message"))


def revision_hits(rules: DataFrame, revisions: DataFrame) -> DataFrame:
    """``revisions(indicator, observation_id, vintage, revision_no, value)``: the newest value that is no first print."""
    last = latest_per_key(revisions.where("revision_no > 0"), ["indicator"], ["vintage", "revision_no"])
    j = rules.where((F.col("kind") == "MACRO_REVISION") & (F.col("scope") == "macro_indicator")).join(last, F.col("ref") == F.col("indicator"))
    return _hit(j, F.col("observation_id"), F.lit(None), F.concat("indicator", F.lit(" revised to "), F.col("value").cast("string")))


def policy_hits(rules: DataFrame, policies: DataFrame, newest: int = 20) -> DataFrame:
    """``policies(bank, document_id, published_at, decision, stance, change_bps)``: among the ``newest`` documents of a bank the
    last decision other than OTHER; or the last known stance, if it differs from the known one before."""
    place = F.row_number().over(Window.partitionBy("bank").orderBy(F.desc("published_at"), F.desc("document_id")))
    recent = policies.withColumn("_n", place).where(F.col("_n") <= newest)  # so many rows a bank are gathered
    docs = recent.groupBy("bank").agg(F.sort_array(F.collect_list(F.struct("published_at", "document_id", "decision", "stance", "change_bps")), False).alias("d"))
    decided = F.get(F.filter("d", lambda x: x["decision"].isNotNull() & (x["decision"] != "OTHER")), F.lit(0))
    stances = F.filter("d", lambda x: x["stance"].isNotNull() & (x["stance"] != "UNKNOWN"))
    state = docs.select("bank", decided.alias("decided"), F.get(stances, F.lit(0)).alias("now"), F.get(stances, F.lit(1)).alias("before"))
    j = rules.where(F.col("kind").isin(POLICY) & (F.col("scope") == "central_bank")).join(state, F.col("ref") == F.col("bank"))
    made = F.col("kind") == "CENTRAL_BANK_DECISION"
    fires = F.when(made, F.col("decided").isNotNull()).otherwise(F.col("before").isNotNull() & (F.col("now.stance") != F.col("before.stance")))
    step = F.when(F.col("decided.change_bps").isNull(), "").otherwise(F.concat(F.lit(" ("), F.round("decided.change_bps").cast("long").cast("string"), F.lit(" bp)")))
    said = F.when(made, F.concat("bank", F.lit(" decision: "), "decided.decision", step)).otherwise(F.concat("bank", F.lit(" stance: "), "before.stance", F.lit(" -> "), "now.stance"))
    return _hit(j.where(fires), F.when(made, F.col("decided.document_id")).otherwise(F.col("now.document_id")), F.lit(None), said)


def research_hits(rules: DataFrame, articles: DataFrame, since: Column, until: Column) -> DataFrame:
    """``articles(article_id, asset, institution, title, published_at)``, a row an asset: the newest ready article about an
    asset, or of an institution, within a time."""
    recent = articles.where((F.col("published_at") >= since) & (F.col("published_at") <= until))
    each = recent.select("article_id", "institution", "title", "published_at", F.explode(F.array(F.struct(F.lit("asset").alias("scope"), F.col("asset").alias("ref")), F.struct(F.lit("institution").alias("scope"), F.col("institution").alias("ref")))).alias("w"))
    last = each.select("article_id", "institution", "title", "published_at", "w.*").where("ref IS NOT NULL").groupBy("scope", "ref").agg(F.max(F.struct("published_at", "article_id", "institution", "title")).alias("a"))
    j = rules.where(F.col("kind") == "RESEARCH").join(last, ["scope", "ref"])
    return _hit(j, F.col("a.article_id"), F.lit(None), F.concat("a.institution", F.lit(": "), "a.title"))
