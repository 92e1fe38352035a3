"""Queries over the structure of whole texts: parts and batches, blocks, dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators.articles import BULLETS, parts, publication_dates, structured
from lodestream.plans.base import query
from lodestream.session import table
from lodestream.sources.extract import articles

#: Documents have lines and no blank ones: their parts are cut at line ends, at this many characters.
PART_CHARS = 1500

_STATE = "{'n': %s, 'at': 0::BIGINT, 'a': -1::BIGINT, 'b': 0::BIGINT, 'out': []::BIGINT[]}"
_STEP = f"""{{'n': x.n, 'at': s.at + x.n + 1,
  'a': CASE WHEN x.n = 0 THEN s.a WHEN s.a >= 0 AND s.at + x.n - s.a <= {PART_CHARS} THEN s.a WHEN x.n <= {PART_CHARS} THEN s.at ELSE -1::BIGINT END,
  'b': CASE WHEN x.n = 0 THEN s.b ELSE s.at + x.n END,
  'out': CASE WHEN x.n = 0 OR (s.a >= 0 AND s.at + x.n - s.a <= {PART_CHARS}) THEN s.out ELSE s.out || CASE WHEN s.a >= 0 THEN [s.b - s.a] ELSE []::BIGINT[] END
    || CASE WHEN x.n > {PART_CHARS} THEN list_transform(range(0::BIGINT, x.n, {PART_CHARS}), lambda i: least({PART_CHARS}, x.n - i)) ELSE []::BIGINT[] END END}}"""


@query(f"""WITH t AS (SELECT doc_id, length(text)::BIGINT AS n, list_transform(string_split(text, chr(10)), lambda l: {_STATE % 'length(l)::BIGINT'}) AS ls FROM documents),
f AS (SELECT doc_id, n, list_reduce(list_prepend({_STATE % '0::BIGINT'}, ls), lambda s, x: {_STEP}) AS s FROM t),
p AS (SELECT doc_id, CASE WHEN n <= {PART_CHARS} THEN [n] WHEN s.a >= 0 THEN s.out || [s.b - s.a] ELSE s.out END AS sizes FROM f),
b AS (SELECT doc_id, sizes, list_reduce(list_prepend({{'n': 0::BIGINT, 'batch': 0::BIGINT, 'total': -1::BIGINT}}, list_transform(sizes, lambda z: {{'n': z, 'batch': 0::BIGINT, 'total': 0::BIGINT}})),
  lambda s, x: {{'n': x.n, 'batch': CASE WHEN s.total >= 0 AND s.total + x.n > {PART_CHARS} THEN s.batch + 1 ELSE s.batch END, 'total': CASE WHEN s.total >= 0 AND s.total + x.n <= {PART_CHARS} THEN s.total + x.n ELSE x.n END}}) AS s FROM p)
SELECT doc_id, len(sizes) AS parts, (s.batch + CASE WHEN len(sizes) > 0 THEN 1 ELSE 0 END)::BIGINT AS batches, list_max(sizes)::BIGINT AS longest, list_sum(sizes)::BIGINT AS chars FROM b WHERE len(sizes) > 0""")
def text_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of each document and the batches that they are packed into."""
    p = parts(table(spark, d, "documents"), "doc_id", "text", PART_CHARS, r"\n")
    size = F.col("ends") - F.col("begins")
    return p.groupBy("doc_id").agg(F.count("*").alias("parts"), (F.max("batch") + 1).cast("long").alias("batches"), F.max(size).cast("long").alias("longest"), F.sum(size).alias("chars"))


_SIGNS = BULLETS.replace("-", "") + r"\-"


@query(rf"""WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '' AND NOT regexp_matches(x, '^[{_SIGNS}]\s+$')) AS ls FROM documents)),
k AS (SELECT *, regexp_matches(line, '^[{_SIGNS}]\s') AS item, coalesce(lag(regexp_matches(line, '^[{_SIGNS}]\s')) OVER (PARTITION BY doc_id ORDER BY i), false) AS before FROM l)
SELECT doc_id, count(*) FILTER (NOT item) AS paragraphs, count(*) FILTER (item AND NOT before) AS lists, count(*) FILTER (item) AS items, max(length(line) - CASE WHEN item THEN 2 ELSE 0 END)::BIGINT AS longest FROM k GROUP BY 1""")
def article_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs, lists and items of each document. (The documents end in no disclaimer; the SQL knows none.)"""
    s = structured(table(spark, d, "documents"), "doc_id", "text")
    listed = F.col("kind") == "list"
    return s.groupBy("doc_id").agg(F.count_if(~listed).alias("paragraphs"), F.count_if(listed & (F.col("item") == 0)).alias("lists"), F.count_if(listed).alias("items"), F.max(F.length("line")).cast("long").alias("longest"))


@query()
def page_dates(spark: SparkSession, d: str) -> DataFrame:
    """The date that a page's address and title tell, null without one (ranked shapes: no SQL twin)."""
    pages = table(spark, d, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    return publication_dates(pages, "page_id", ["url", "title"], dt.date(2026, 9, 20))


@query()
def page_articles(spark: SparkSession, d: str) -> DataFrame:
    """What the article of each page holds (the densest container of a tree of nodes: no SQL twin)."""
    a = articles(table(spark, d, "pages"), "page_id", "html", "url", dt.date(2026, 9, 20))
    chars = F.aggregate("sections", F.lit(0), lambda s, x: s + F.length(x["text"]))
    return a.select("page_id", "title", F.size("sections").alias("sections"), F.size("tables").alias("tables"), F.size("figures").alias("figures"), chars.alias("chars"), "published")
