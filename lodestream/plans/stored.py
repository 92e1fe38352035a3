"""Queries over stored tables: gate verdicts kept up to date, updates from a join, deletes by a subquery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators.gate import BARE_TITLES, COMPOUNDS, FILE_WORDS, INPUTS, OPENING_VERBS, eligibility, gate_issues, refresh_verdicts, with_facts
from lodestream.plans.base import query
from lodestream.session import new_path, table
from lodestream.sources.versioned import VersionedTable
from lodestream.streaming.counters import calls, counters

_any = "|".join


def articles(spark: SparkSession, d: str, reviewed: bool) -> DataFrame:
    """Documents as articles: the head of a text is its title, the piece after it its summary; labels are the reviews."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    status = F.lit(None).cast("string")
    if reviewed:
        labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        docs = docs.join(labels, "doc_id", "left")
        status = F.when(F.col("quality") == 1, "ok").when(F.col("quality") == 0, "needs_review")
    no = F.lit(None).cast("string")
    return docs.select(
        "doc_id", F.regexp_extract("text", r"^[^.!?\n]*", 0).alias("title"), "text", F.concat(F.lit("https://"), F.col("source"), F.lit("/"), F.col("doc_id")).alias("url"),
        F.col("lang").alias("language"), F.regexp_extract("text", r"[.!?]\s+([^.!?\n]+)", 1).alias("summary"), no.alias("summary_zh"), status.alias("review_status"),
        no.alias("translation_title"), no.alias("translation_text"),
    )


_HAN, _L = r"\p{Han}", r"\p{L}"
_NOISE = [f"^({_any(BARE_TITLES)}|download( the)? (pdf|report|document))$", rf"^({_any(FILE_WORDS)})\b", rf"^({_any(OPENING_VERBS)})\s+((the|this)\s+)?({_any(FILE_WORDS)})\b",
          r"\b(of entire text|full document|entire document)\b", "uploaded (document|file)", r"^untitled\b", r"\b(pdf|document|file)\b[^a-z]{0,20}\b\d+\s*(kb|mb|k|m)\b"]


def _sql_count(text: str, letters: str) -> str:
    return f"length(regexp_replace({text}, '[^{letters}]', '', 'g'))"


def _sql_strip(text: str) -> str:
    return rf"regexp_replace(coalesce({text}, ''), '^\s+|\s+$', '', 'g')"


#: Common to both queries: articles with their parts and issue lists.
_ARTICLES = rf"""a AS (
  SELECT d.doc_id, {_sql_strip("regexp_extract(text, '^[^.!?\n]*')")} AS title, {_sql_strip('text')} AS body, {_sql_strip(r"regexp_extract(text, '[.!?]\s+([^.!?\n]+)', 1)")} AS summary, lang,
    CASE max_q WHEN 1 THEN 'ok' WHEN 0 THEN 'needs_review' END AS status, l.doc_id IS NOT NULL AS reviewed
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS max_q FROM labels GROUP BY 1) l USING (doc_id)
), b AS (
  SELECT *, title || chr(10) || left(body, 5000) AS head, list_filter(regexp_split_to_array(lower(title || chr(10) || left(body, 5000)), '[^a-z]+'), lambda w: w <> '') AS ws,
    coalesce(regexp_matches(lower(lang), '^zh\b'), false) OR ({_sql_count("title || left(body, 2000)", _L)} >= 20 AND {_sql_count("title || left(body, 2000)", _HAN)} >= 0.2 * {_sql_count("title || left(body, 2000)", _L)}) AS native
  FROM a
), c AS (
  SELECT *, [CASE WHEN length(title) < 8 OR length(title) > 180 OR {' OR '.join(f"regexp_matches(lower(title), '{n}')" for n in _NOISE)} OR (NOT regexp_matches(title, '{_HAN}') AND {_sql_count('title', _L)} < 6) THEN 'abnormal_title' END,
    CASE WHEN regexp_matches(lower(title), '^((article\s+)?coming\s+soon|(文章|内容)?即将发布|敬请期待)$') OR regexp_matches(lower(left(body, 2000)), '\barticle\s+coming\s+soon\b|(文章|内容)即将发布|敬请期待') THEN 'placeholder_content' END,
    CASE WHEN regexp_matches(head, '\x{{FFFD}}|Ã.|Â.|â€') OR (regexp_matches(regexp_replace(lower(head), '[^a-z]+', '', 'g'), '{_any(COMPOUNDS)}') AND len(list_filter(range(0, len(ws)), lambda i: len(list_filter([2, 3, 4, 5], lambda n: i + n <= len(ws) AND array_to_string(ws[i + 1:i + n], '') IN ({', '.join(f"'{w}'" for w in COMPOUNDS)}) AND list_min(list_transform(ws[i + 1:i + n], lambda w: length(w))) <= 2)) > 0)) > 0) THEN 'garbled_or_broken_words' END,
    CASE WHEN length(body) < 300 THEN 'thin_content' END, CASE WHEN summary = '' THEN 'empty_summary' END,
    CASE WHEN lang = 'en' AND regexp_matches(title, '{_HAN}') AND NOT native THEN 'source_language_mismatch' END, CASE WHEN status <> 'ok' THEN 'analysis_needs_review' END] AS found
  FROM b
)"""


def _codes(column: str = "found") -> str:
    return f"list_filter({column}, lambda x: x IS NOT NULL)"


@query(f"WITH {_ARTICLES} SELECT doc_id, array_to_string({_codes()}, ',') AS issues, CASE WHEN title = '' OR body = '' THEN 'NOT_GENERATED' WHEN len({_codes()}) > 0 THEN 'NOINDEX_FOLLOW' ELSE 'INDEX' END AS eligibility FROM c")
def gate_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """The gate's issues and what follows from them, for every document as an English page."""
    given = {c: F.col(c) for c in INPUTS}
    a, facts = with_facts(articles(spark, d, True))
    a = a.withColumn("i", gate_issues("en", facts, **given))
    return a.select("doc_id", F.concat_ws(",", "i").alias("issues"), eligibility(F.col("title"), F.col("text"), F.col("url"), F.col("i")).alias("eligibility"))


@query(f"""WITH {_ARTICLES} SELECT doc_id, array_to_string({_codes()}, ',') AS issues_en, array_to_string({_codes("found[1:4] || [CASE WHEN native AND summary <> '' THEN NULL ELSE 'empty_summary' END] || found[6:7] || [CASE WHEN NOT native THEN 'missing_translation' END]")}, ',') AS issues_zh,
len({_codes()}) = 0 AND title <> '' AND body <> '' AS indexable_en, reviewed AS computed_again FROM c""")
def stored_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of all documents stored before the reviews are known, then refreshed: only reviewed ones are computed again."""
    store = VersionedTable(spark, new_path(spark, "verdicts"))
    refresh_verdicts(store, articles(spark, d, False), "doc_id", 1)
    first = store.version()
    refresh_verdicts(store, articles(spark, d, True), "doc_id", 1)
    before = store.read(first).select(F.col("doc_id").alias("b"), F.col("digest").alias("was"))
    j = store.read().join(before, F.col("doc_id") == F.col("b"))
    return j.select("doc_id", F.concat_ws(",", "issues_en").alias("issues_en"), F.concat_ws(",", "issues_zh").alias("issues_zh"), "indexable_en", (F.col("digest") != F.col("was")).alias("computed_again"))


def article_slug(source: Column, title: Column, key: Column) -> Column:
    """Lower-cased source and title in words of a-z and 0-9, at most 109 characters ("research" without any), then the end of the key."""
    words = F.regexp_replace(F.lower(F.concat(F.coalesce(source, F.lit("")), F.lit("-"), F.coalesce(title, F.lit("")))), "[^a-z0-9]+", "-")
    bare = F.regexp_replace(words, "^-+|-+$", "")
    return F.concat(F.left(F.coalesce(F.nullif(bare, F.lit("")), F.lit("research")), F.lit(109)), F.lit("-"), F.right(key.cast("string"), F.lit(10)))


@query(r"""SELECT c_custkey, CASE WHEN n_regionkey IS NULL THEN NULL ELSE left(coalesce(nullif(trim(regexp_replace(lower(concat(n_name, '-', c_name)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'research'), 109) || '-' || right(c_custkey::VARCHAR, 10) END AS slug
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey = (SELECT min(r_regionkey) FROM region WHERE r_name LIKE 'A%')""")
def update_from_join(spark: SparkSession, d: str) -> DataFrame:
    """UPDATE customer SET slug = ... FROM nation, for the nations of one region; files of others stay."""
    store = VersionedTable(spark, new_path(spark, "customers"))
    store.create(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", F.lit(None).cast("string").alias("slug")), ["c_nationkey"])
    region = table(spark, d, "region").where("r_name LIKE 'A%'").agg(F.min("r_regionkey").alias("r"))
    nations = table(spark, d, "nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("r")).select("n_nationkey", "n_name")
    store.update_from(nations, {"c_nationkey": "n_nationkey"}, {"slug": article_slug(F.col("o.n_name"), F.col("t.c_name"), F.col("t.c_custkey"))})
    return store.read().select("c_custkey", "slug")


@query(r"""SELECT p_partkey, p_name FROM part WHERE NOT (p_brand = (SELECT min(p_brand) FROM part) AND coalesce(regexp_matches(p_name, '^[a-f][a-z]* [a-m]'), false))""")
def delete_by_subquery(spark: SparkSession, d: str) -> DataFrame:
    """DELETE FROM part WHERE brand = (SELECT ...) AND name ~ ...; only files with such rows are rewritten."""
    store = VersionedTable(spark, new_path(spark, "parts"))
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    store.create(parts, ["p_brand"])
    store.delete_where(F.col("p_name").rlike("^[a-f][a-z]* [a-m]"), parts.agg(F.min("p_brand").alias("first")), {"p_brand": "first"})
    return store.read().select("p_partkey", "p_name")


@query(r"""WITH p AS (SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)', 1) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+([^?#]*)', 1) AS path, length(html) AS n FROM pages)
SELECT '2024-01-01' AS day, host AS owner, CASE WHEN host = '' THEN 'unknown' ELSE left(array_to_string(list_transform(string_split(CASE WHEN path = '' THEN '/' ELSE path END, '/'), lambda s: CASE WHEN regexp_matches(s, '^([0-9]+|[0-9A-Za-z]{16,})$') THEN '{id}' ELSE s END), '/'), 120) END AS endpoint, 200::INT AS status, count(*) AS calls, sum(coalesce(n, 0))::BIGINT AS total_ms
FROM p GROUP BY ALL""")
def endpoint_usage(spark: SparkSession, d: str) -> DataFrame:
    """Counters per host and endpoint with identifiers folded; a page counts as one call that took as long as its html."""
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)", 1)
    return counters(calls(table(spark, d, "pages"), F.lit("2024-01-01").cast("date"), host, F.col("url"), F.lit(200), F.length("html")))
