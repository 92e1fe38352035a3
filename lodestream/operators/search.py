"""Text search by a score ladder, and the normal form of what is searched."""

from __future__ import annotations

import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def normal_form(text: Column, ascii_only: bool = False) -> Column:
    """Lower case without accents, ``&`` as "and", single blanks for everything but letters and digits.

    ``ascii_only`` promises plain ASCII, for which no Python runs (Spark has no compatibility decomposition).
    """
    t = text if ascii_only else F.regexp_replace(_decomposed(text), r"\p{M}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), "&", " and "), r"[^\p{L}\p{N}]+", " "))


def _score_of_word(word: Column, term: str) -> Column:
    """Equal 48, one the beginning of the other 40, within 32, few typing errors 30 less 6 for each."""
    size = len(term)
    best = F.when(word == term, 48).when(F.startswith(word, F.lit(term)) | ((F.length(word) >= 3) & F.startswith(F.lit(term), word)), 40).when(F.contains(word, F.lit(term)), 32)
    if size >= 3 and term.isascii() and term.isalnum():
        most, far = (1 if size <= 5 else 2), F.levenshtein(word, F.lit(term), 3)
        best = best.when((F.length(word) >= 3) & (F.abs(F.length(word) - size) <= most) & far.between(0, most), 30 - far * 6)
    return best.otherwise(0)


def _dice(compact: Column, query: str) -> Column:
    """Twice the shared bigrams over all; a pair of two different letters cannot overlap itself, so removing it counts it."""
    pairs = Counter(query[i : i + 2] for i in range(len(query) - 1))

    def count(pair: str) -> Column:
        if pair[0] != pair[1]:
            return (F.length(compact) - F.length(F.replace(compact, F.lit(pair), F.lit("")))) / 2
        return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(compact) - 1, F.lit(1))), lambda i: F.substr(compact, i, F.lit(2)) == pair))

    common = sum((F.least(F.lit(n), count(p)) for p, n in sorted(pairs.items())), F.lit(0))
    return F.when(F.length(compact) >= 2, 2.0 * common / (F.length(compact) - 1 + sum(pairs.values()))).otherwise(0.0)


def text_scores(texts: DataFrame, queries: list[str]) -> DataFrame:
    """``texts(text)``, distinct, in normal form -> (text, asked, score), scores of 0 left out; ``asked`` is a query's place.

    The ladder: equal 160, beginning 125, within 105, within without blanks 95; else the mean of what the query's words score
    if all of them do; else 36 times the share of common bigrams, from 0.45 on. Each distinct word is held against each
    distinct query word once, and the scores are joined back.
    """
    compact = F.replace("text", F.lit(" "), F.lit(""))

    def whole(n: int, q: str) -> Column:
        tight = q.replace(" ", "")
        step = F.when(F.col("text") == q, 160.0).when(F.startswith("text", F.lit(q)), 125.0).when(F.contains("text", F.lit(q)), 105.0).when(F.contains(compact, F.lit(tight)), 95.0).otherwise(0.0)
        dice = F.when((F.length(compact) <= 240) & F.lit(len(tight) >= 4), _dice(compact, tight)).otherwise(0.0)
        return F.struct(F.lit(n).alias("asked"), step.alias("step"), F.when(step == 0, dice).otherwise(0.0).alias("dice"))

    texts = texts.where("text <> ''")
    direct = texts.select("text", F.explode(F.array(*[whole(n, q) for n, q in enumerate(queries)])).alias("s")).select("text", "s.*").where("step > 0 OR dice >= 0.45")
    terms = sorted({t for q in queries for t in q.split(" ")})
    said = texts.select("text", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    scored = said.select("word").distinct().select("word", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), _score_of_word(F.col("word"), t).alias("points")) for t in terms])).alias("s")).select("word", "s.*").where("points > 0")
    needs = {t: [(n, q.split(" ").count(t), len(q.split(" "))) for n, q in enumerate(queries) if t in q.split(" ")] for t in terms}
    asks = F.coalesce(*[F.when(F.col("term") == t, F.array(*[F.struct(F.lit(n).alias("asked"), F.lit(c).alias("times"), F.lit(size).alias("size")) for n, c, size in needs[t]])) for t in terms])
    best = said.join(scored, "word").groupBy("text", "term").agg(F.max("points").alias("points"))
    every = best.select("text", "points", F.explode(asks).alias("a")).groupBy("text", "a.asked").agg(F.sum("a.times").alias("found"), F.max("a.size").alias("size"), F.sum(F.col("points") * F.col("a.times")).alias("points"))
    every = every.where("found = size").select("text", "asked", (F.col("points") / F.col("size").cast("double")).alias("mean"))
    both = direct.join(every, ["text", "asked"], "full")
    return both.select("text", "asked", F.when(F.col("step") > 0, F.col("step")).otherwise(F.coalesce("mean", F.col("dice") * 36)).alias("score"))


def ranked_search(fields: DataFrame, queries: list[str], top: int = 12, least: float = 18, per_group: int | None = None) -> DataFrame:
    """``fields(item, weight, text[, boost, recency, group])`` -> the ``top`` items of each query: (asked, item, score).

    ``text`` is in normal form; an item's score is the largest of weight times score over its fields, times its ``boost``.
    For a query of one word of four and more letters and digits, half its trigrams must occur in what the item says.
    Equal scores come by the larger ``recency``, then the smaller item. Of one ``group`` (an article with many views) at
    most ``per_group`` items come; items without a group are not limited.
    """
    extra = {"boost": F.lit(1.0), "recency": F.lit(0), "group": F.lit(None).cast("string")}
    rows = fields.select("item", "weight", "text", *[F.col(c) if c in fields.columns else v.alias(c) for c, v in extra.items()])
    parts = {n: [q[i : i + 3] for i in range(len(q) - 2)] for n, q in enumerate(queries) if len(q) >= 4 and q.isascii() and q.isalnum()}
    hits = rows.join(text_scores(rows.select("text").distinct(), queries), "text")
    best = hits.groupBy("asked", "item").agg(F.max(F.col("score") * F.col("weight") * F.col("boost")).alias("score"), F.first("recency").alias("recency"), F.first("group").alias("group"))
    best = best.where(F.col("score") >= least)
    if parts:  # which trigrams of which query an item has, over all its fields
        has = [F.struct(F.lit(n).alias("asked"), F.lit(p).alias("part"), F.contains("text", F.lit(p)).alias("there")) for n, own in parts.items() for p in sorted(set(own))]
        count = {n: Counter(own) for n, own in parts.items()}
        times = F.coalesce(*[F.when((F.col("asked") == n) & (F.col("part") == p), k) for n, own in count.items() for p, k in own.items()])
        found = rows.select("item", F.explode(F.array(*has)).alias("h")).where("h.there").select("item", "h.asked", "h.part").distinct().groupBy("asked", "item").agg(F.sum(times).alias("found"))
        enough = F.coalesce(*[F.when(F.col("asked") == n, -(-len(own) // 2)) for n, own in parts.items()], F.lit(0))
        best = best.join(found, ["asked", "item"], "left").where(F.coalesce("found", F.lit(0)) >= enough)
    order = [F.desc("score"), F.desc("recency"), F.col("item")]
    if per_group:
        rank = F.row_number().over(Window.partitionBy("asked", "group").orderBy(*order))
        best = best.withColumn("_n", F.when(F.col("group").isNull(), 1).otherwise(rank)).where(F.col("_n") <= per_group)
    return best.withColumn("_r", F.row_number().over(Window.partitionBy("asked").orderBy(*order))).where(F.col("_r") <= top).select("asked", "item", "score")
