"""Document queries: addresses, hashes, gates, evidence, tagging, grounding, fuzzy search, HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.operators.relational import top_per_group
from lodestream.operators.text import (
    TOPICS, bigram_dice, canonical_url, content_key, letter_share, robots_verdict, sentences, title_key, words,
)
from lodestream.plans.base import query
from lodestream.session import table


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


_CANON = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*')), '^http:', 'https:'), '://(www|m|amp)\.', '://') ||
regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/amp/?$', '/'), '(.)/+$', '\1'), '^$', '')"""


@query(f"""WITH q AS (SELECT page_id, {_CANON} AS base, list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS ps FROM pages)
SELECT page_id, base || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS url, sha1(base || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END) AS url_hash FROM q""")
def url_canonical_hash(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", canonical_url(F.col("url")).alias("url"))
    return p.select("page_id", "url", F.sha1(F.col("url").cast("binary")).alias("url_hash"))


_CK = r"sha1(left(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N} ]', ' ', 'g'), ' +', ' ', 'g')), 2000))"
_TK = r"sha1(trim(regexp_replace(regexp_replace(lower(left(text, 60)), '[^\p{L}\p{N} ]', ' ', 'g'), ' +', ' ', 'g')) || '|' || source || '|' || lang)"


@query(f"""WITH h AS (SELECT doc_id, {_CK} AS ck, {_TK} AS tk FROM documents), f AS (SELECT *, min(doc_id) OVER (PARTITION BY ck) AS c1, min(doc_id) OVER (PARTITION BY tk) AS t1 FROM h)
SELECT doc_id, CASE WHEN c1 < doc_id THEN c1 WHEN t1 < doc_id THEN t1 END AS duplicate_of, CASE WHEN c1 < doc_id THEN 'content' WHEN t1 < doc_id THEN 'title' ELSE 'new' END AS outcome FROM f""")
def three_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Content hash first, then title with source and language; the earliest id stays. First ids are aggregated, then joined: no group is gathered."""
    h = docs(spark, d).select("doc_id", content_key(F.col("text")).alias("ck"), title_key(F.col("text"), F.col("source"), F.col("lang")).alias("tk"))
    c, t = h.groupBy("ck").agg(F.min("doc_id").alias("c1")), h.groupBy("tk").agg(F.min("doc_id").alias("t1"))
    j = h.join(c, "ck").join(t, "tk")
    return j.select("doc_id", F.when(F.col("c1") < F.col("doc_id"), F.col("c1")).when(F.col("t1") < F.col("doc_id"), F.col("t1")).alias("duplicate_of"),
                    F.when(F.col("c1") < F.col("doc_id"), "content").when(F.col("t1") < F.col("doc_id"), "title").otherwise("new").alias("outcome"))


@query(f"""SELECT {_CK} AS ck, count(*) AS n, max_by(doc_id, (CASE WHEN lang = 'en' THEN 1 ELSE 0 END, n_chars, -doc_id)) AS survivor FROM documents GROUP BY 1 HAVING count(*) > 1""")
def survivor_choice(spark: SparkSession, d: str) -> DataFrame:
    """The best of each group of copies: English, then longest, then first."""
    g = docs(spark, d).groupBy(content_key(F.col("text")).alias("ck")).agg(
        F.count("*").alias("n"), F.max_by("doc_id", F.struct(F.when(F.col("lang") == "en", 1).otherwise(0).alias("e"), F.col("n_chars"), (-F.col("doc_id")).alias("i"))).alias("survivor"))
    return g.where("n > 1")


@query("SELECT doc_id, lang FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    h = docs(spark, d).select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return h.join(h.groupBy("sha").agg(F.count("*").alias("n")).where("n > 1").select("sha"), "sha", "left_semi").select("doc_id", "lang")


_W = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT doc_id, text, {_W} AS ws FROM documents) SELECT doc_id, len(ws)::INT AS n_words, coalesce(list_max(list_transform(ws, lambda w: length(w))), 0)::INT AS longest,
coalesce(list_max(list_transform(ws, lambda w: length(w))), 0) > 220 OR len(list_filter(ws, lambda w: length(w) > 22)) > 0.06::DOUBLE * len(ws) AS junk FROM w""")
def junk_gate(spark: SparkSession, d: str) -> DataFrame:
    w = docs(spark, d).select("doc_id", words(F.col("text")).alias("ws"))
    longest = F.coalesce(F.array_max(F.transform("ws", F.length)), F.lit(0))
    return w.select("doc_id", F.size("ws").alias("n_words"), longest.alias("longest"), ((longest > 220) | (F.size(F.filter("ws", lambda x: F.length(x) > 22)) > F.size("ws") * 0.06)).alias("junk"))


@query(f"""WITH w AS (SELECT doc_id, length(text) AS n, len({_W}) AS nw, len(regexp_extract_all(text, '[.!?](\\s|$)')) AS ns FROM documents) SELECT doc_id, nw::INT AS n_words, ns::INT AS n_sentences, n >= 700 AND nw >= 60 AND ns >= 4 AS article FROM w""")
def article_gate(spark: SparkSession, d: str) -> DataFrame:
    w = docs(spark, d).select("doc_id", F.length("text").alias("n"), F.size(words(F.col("text"))).alias("n_words"), F.regexp_count("text", F.lit(r"[.!?](\s|$)")).alias("n_sentences"))
    return w.select("doc_id", "n_words", "n_sentences", F.expr("n >= 700 AND n_words >= 60 AND n_sentences >= 4").alias("article"))


_ISSUES = r"""list_filter([CASE WHEN length(text) < 300 THEN 'too_short' END, CASE WHEN length(text) > 10000 THEN 'too_long' END, CASE WHEN regexp_matches(text, '[|#*$%&]{2,}|( \| )') THEN 'markup' END,
CASE WHEN length(regexp_replace(text, '[^A-Z]', '', 'g')) > 0.3::DOUBLE * length(text) THEN 'shouting' END, CASE WHEN NOT regexp_matches(text, '[.!?]') THEN 'no_sentence' END, CASE WHEN regexp_matches(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|[a-z0-9.]+@[a-z0-9]+') THEN 'personal_data' END], lambda c: c IS NOT NULL)"""


def issues(text: Column) -> Column:
    """Codes of what is wrong with a text, in a fixed order."""
    rules = [
        (F.length(text) < 300, "too_short"), (F.length(text) > 10000, "too_long"), (text.rlike(r"[|#*$%&]{2,}|( \| )"), "markup"),
        (F.length(F.regexp_replace(text, "[^A-Z]", "")) > F.length(text) * 0.3, "shouting"), (~text.rlike("[.!?]"), "no_sentence"),
        (text.rlike(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|[a-z0-9.]+@[a-z0-9]+"), "personal_data"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in rules]))


@query(f"SELECT doc_id, array_to_string({_ISSUES}, ',') AS issues, len({_ISSUES}) = 0 AS eligible FROM documents")
def quality_issues_array(spark: SparkSession, d: str) -> DataFrame:
    i = docs(spark, d).select("doc_id", issues(F.col("text")).alias("i"))
    return i.select("doc_id", F.concat_ws(",", "i").alias("issues"), (F.size("i") == 0).alias("eligible"))


@query(f"SELECT code, count(*) AS n, count(DISTINCT source) AS sources FROM (SELECT source, unnest({_ISSUES}) AS code FROM documents) GROUP BY 1")
def issue_histogram(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("source", F.explode(issues(F.col("text"))).alias("code")).groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query(f"""WITH v AS (SELECT d.doc_id, NOT (list_contains({_ISSUES}, 'markup') OR list_contains({_ISSUES}, 'shouting')) AS said, quality = 1 AS truth FROM documents d JOIN labels USING (doc_id))
SELECT count(*) AS n, count(*) FILTER (said = truth) AS correct, count(*) FILTER (said AND NOT truth) AS false_pos, count(*) FILTER (NOT said AND truth) AS false_neg, round(count(*) FILTER (said = truth) / count(*)::DOUBLE, 6) AS accuracy, round(count(*) FILTER (said AND truth) / count(*) FILTER (truth)::DOUBLE, 6) AS recall FROM v""")
def label_eval_confusion(spark: SparkSession, d: str) -> DataFrame:
    """How the gate's verdict agrees with the labels."""
    i = issues(F.col("text"))
    said = docs(spark, d).select("doc_id", (~(F.array_contains(i, "markup") | F.array_contains(i, "shouting"))).alias("said"))
    v = said.join(table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("truth")), "doc_id")
    g = v.agg(F.count("*").alias("n"), F.count_if(F.expr("said = truth")).alias("correct"), F.count_if(F.expr("said AND NOT truth")).alias("false_pos"), F.count_if(F.expr("NOT said AND truth")).alias("false_neg"),
              F.count_if(F.expr("said AND truth")).alias("tp"), F.count_if("truth").alias("pos"))
    return g.select("n", "correct", "false_pos", "false_neg", F.round(F.col("correct") / F.col("n"), 6).alias("accuracy"), F.round(F.col("tp") / F.nullif(F.col("pos"), F.lit(0)), 6).alias("recall"))


@query()
def sentence_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Up to 12 sentences a document with a figure or a stance word, abbreviations not split (Java look-behind: no SQL twin)."""
    s = docs(spark, d).select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    figure, stance = F.col("sentence").rlike("[0-9]"), F.lower("sentence").rlike(r"\b(the|not|with|from)\b")
    rows = s.where(F.length("sentence").between(12, 400) & (figure | stance)).dropDuplicates(["doc_id", "sentence"])
    return top_per_group(rows.withColumn("score", figure.cast("int") * 2 + stance.cast("int")), ["doc_id"], [F.desc("score"), F.col("pos")], 12).select("doc_id", "pos", "score", "sentence")


POSITIVE, NEGATIVE = ["good", "the", "from", "que"], ["not", "was", "und", "les"]


@query(f"""WITH c AS (SELECT doc_id, {' + '.join(f"contains(lower(text), '{w}')::INT" for w in POSITIVE)} - ({' + '.join(f"contains(lower(text), '{w}')::INT" for w in NEGATIVE)}) AS net FROM documents)
SELECT doc_id, greatest(-2, least(2, net))::INT AS direction, round(least(0.95::DOUBLE, 0.5::DOUBLE + 0.12::DOUBLE * abs(net)), 4) AS confidence FROM c""")
def lexicon_direction(spark: SparkSession, d: str) -> DataFrame:
    """Direction from a word list: net hits, clipped, and a confidence that grows with them."""
    low = F.lower("text")
    net = sum((F.contains(low, F.lit(w)).cast("int") for w in POSITIVE), F.lit(0)) - sum((F.contains(low, F.lit(w)).cast("int") for w in NEGATIVE), F.lit(0))
    c = docs(spark, d).select("doc_id", net.alias("net"))
    return c.select("doc_id", F.greatest(F.lit(-2), F.least(F.lit(2), "net")).cast("int").alias("direction"), F.round(F.least(F.lit(0.95), 0.5 + 0.12 * F.abs("net")), 4).alias("confidence"))


ALIASES = {"gold": ["than", "heon"], "oil": ["ering"], "euro": ["des", "der"], "peso": ["los", "del"]}
_ALIAS_SQL = ", ".join(f"('{a}', '{w}')" for a, ws in ALIASES.items() for w in ws)


@query(f"""WITH a(asset, alias) AS (VALUES {_ALIAS_SQL}), w AS (SELECT doc_id, i, w FROM (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS ws FROM documents))),
h AS (SELECT doc_id, asset, count(*) + 3 * max((i < 12)::INT) AS score, count(*) AS n, bool_or(i < 12) AS titled FROM w JOIN a ON alias = w GROUP BY ALL)
SELECT doc_id, asset, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, asset) AS rk FROM h WHERE titled OR n >= 2) WHERE rk <= 4""")
def alias_tagging(spark: SparkSession, d: str) -> DataFrame:
    """Assets named in a text: whole-word mentions, three points for one among the first 12 words; in the head or twice, four at most."""
    a = spark.createDataFrame([(a, w) for a, ws in ALIASES.items() for w in ws], "asset string, w string")
    ws = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    keys = [w for ws_ in ALIASES.values() for w in ws_]
    w = docs(spark, d).select("doc_id", F.posexplode(ws).alias("i", "w")).where(F.col("w").isin(keys))
    h = w.join(F.broadcast(a), "w").groupBy("doc_id", "asset").agg(F.count("*").alias("n"), F.bool_or(F.col("i") < 12).alias("titled"))  # a fixed list
    h = h.where("titled OR n >= 2").withColumn("score", F.col("n") + 3 * F.col("titled").cast("int"))
    return top_per_group(h, ["doc_id"], [F.desc("score"), F.col("asset")], 4).select("doc_id", "asset", "score")


@query(r"""WITH n AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(text, '[0-9]+')) AS nums FROM conversations), u AS (SELECT conv_id, list_distinct(flatten(list(nums))) AS known FROM n WHERE role = 'user' GROUP BY 1)
SELECT n.conv_id, n.turn, len(nums)::INT AS figures, len(list_filter(nums, lambda x: NOT list_contains(coalesce(known, []), x)))::INT AS ungrounded FROM n LEFT JOIN u USING (conv_id) WHERE role = 'assistant'""")
def number_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Figures in an answer that no question of the conversation holds."""
    n = table(spark, d, "conversations").select("conv_id", "turn", "role", F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]+)"), 1)).alias("nums"))
    known = n.where("role = 'user'").select("conv_id", F.explode("nums").alias("x")).groupBy("conv_id").agg(F.collect_set("x").alias("known"))
    a = n.where("role = 'assistant'").join(known, "conv_id", "left")
    return a.select("conv_id", "turn", F.size("nums").alias("figures"), F.size(F.array_except("nums", F.coalesce("known", F.array().cast("array<string>")))).alias("ungrounded"))


@query(r"""WITH b AS (SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS q FROM benchmark), t AS (SELECT doc_id, lower(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents) SELECT item_id, doc_id FROM b JOIN t ON contains(x, q)""")
def quote_containment(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a quote after folding blanks and case."""
    return quotes_in(docs(spark, d), table(spark, d, "benchmark"))


def quotes_in(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """(item_id, doc_id) of the ``quotes(item_id, text)`` that ``texts(doc_id, text)`` contain, blanks and case folded.

    The first and last word of a quote may be parts of longer ones in a text, so the words between them, four at most,
    are hashed and looked up among the texts' word windows; containment is then checked. Quotes without such words
    (a stated set) are tried on every text.
    """
    fold = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    b = quotes.select("item_id", F.trim(fold(F.col("text"))).alias("q")).where("q <> ''").withColumn("ws", F.split("q", " "))
    b = b.withColumn("k", F.least(F.size("ws") - 2, F.lit(4))).withColumn("h", F.when(F.col("k") >= 1, F.xxhash64(F.slice("ws", F.lit(2), F.greatest("k", F.lit(1))))))
    t = texts.where("text IS NOT NULL").select("doc_id", fold(F.col("text")).alias("x"))
    sizes = sorted(r["k"] for r in b.select("k").distinct().collect())  # six values at most
    ws = t.select("doc_id", F.split("x", " ").alias("ws"))
    window = lambda k: lambda i: F.xxhash64(F.slice("ws", i, k))
    each = [F.when(F.size("ws") >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - (k - 1), F.lit(1))), window(k))).otherwise(F.array().cast("array<bigint>")) for k in sizes if k >= 1]
    out = []
    if each:
        hs = ws.select("doc_id", F.explode(F.array_distinct(F.concat(*each))).alias("h"))
        found = hs.join(b.where("k >= 1").select("item_id", "h"), "h").select("doc_id", "item_id").distinct()
        out.append(found.join(t.join(found.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id").join(b.select("item_id", "q"), "item_id").where(F.contains("x", F.col("q"))).select("item_id", "doc_id"))
    if any(k < 1 for k in sizes):
        short = b.where("k < 1").select("item_id", "q")
        out.append(t.join(short, F.contains("x", F.col("q"))).select("item_id", "doc_id"))
    return out[0] if len(out) == 1 else out[0].union(out[1]) if out else t.select(F.lit(None).cast("long").alias("item_id"), "doc_id").where("false")


_TOPIC_SQL = " UNION ALL ".join(f"SELECT '{k}' AS topic, doc_id, source, lang FROM documents WHERE regexp_matches(lower(text), '{p}')" for k, p in TOPICS.items())


@query(f"SELECT topic, count(*) AS n, count(DISTINCT source) AS sources, count(*) FILTER (lang = 'en') AS en FROM ({_TOPIC_SQL}) GROUP BY 1 HAVING count(*) >= 3")
def topic_index(spark: SparkSession, d: str) -> DataFrame:
    """Topics with their documents, sources and English share; one scan tags all topics."""
    tags = F.array_compact(F.array(*[F.when(F.lower("text").rlike(p), F.lit(k)) for k, p in TOPICS.items()]))
    t = docs(spark, d).select("source", "lang", F.explode(tags).alias("topic"))
    return t.groupBy("topic").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.count_if(F.col("lang") == "en").alias("en")).where("n >= 3")


@query("""WITH p AS (SELECT p_partkey, lower(p_name) AS t FROM part), g AS (SELECT p_partkey, list_distinct([substr(t, i::BIGINT, 3) FOR i IN range(1, greatest(length(t) - 1, 1))]) AS tri FROM p),
q(q) AS (VALUES ('linen cloud'), ('steel ring'), ('part 17')), qg AS (SELECT q, list_distinct([substr(q, i::BIGINT, 3) FOR i IN range(1, length(q) - 1)]) AS qt FROM q)
SELECT q, p_partkey, len(list_intersect(tri, qt))::BIGINT AS shared FROM g, qg WHERE len(list_intersect(tri, qt)) * 2 >= len(qt)""")
def trigram_prefilter(spark: SparkSession, d: str) -> DataFrame:
    """Names that share at least half of a query's trigrams, through an inverted index join."""
    tri = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    p = table(spark, d, "part").select("p_partkey", F.explode(tri(F.lower("p_name"))).alias("t"))
    q = spark.createDataFrame([("linen cloud",), ("steel ring",), ("part 17",)], "q string").select("q", tri(F.col("q")).alias("qt"))
    q = q.select("q", F.size("qt").alias("n"), F.explode("qt").alias("t"))
    return p.join(F.broadcast(q), "t").groupBy("q", "p_partkey", "n").agg(F.count("*").alias("shared")).where("shared * 2 >= n").select("q", "p_partkey", "shared")  # three given queries


@query()
def dice_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Best Dice score of bigram multisets of each part's name against three given queries."""
    p = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("t"))
    scores = [F.struct(F.round(bigram_dice(F.col("t"), F.lit(q)), 6).alias("dice"), F.lit(q).alias("q")) for q in ("linen cloud", "steel ring", "part 17")]
    return p.select("p_partkey", F.array_max(F.array(*scores)).alias("b")).select("p_partkey", "b.q", "b.dice")


@query("""WITH q(q) AS (VALUES ('customer#000000012'), ('custmer#000000077'), ('suplier#000000003')), n AS (SELECT 'customer' AS kind, c_custkey AS key, lower(c_name) AS t FROM customer UNION ALL SELECT 'supplier', s_suppkey, lower(s_name) FROM supplier),
s AS (SELECT q, kind, key, CASE WHEN t = q THEN 160 WHEN starts_with(t, q) THEN 125 WHEN contains(t, q) THEN 105 WHEN levenshtein(t, q) <= 2 THEN 95 - 10 * levenshtein(t, q) END AS score FROM n, q)
SELECT q, kind, key, score::BIGINT AS score FROM s WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, kind, key) <= 10""")
def fuzzy_search_topk(spark: SparkSession, d: str) -> DataFrame:
    """Names near a query: equal, prefix, part, or at most two edits away; the ten best."""
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.lower("c_name").alias("t"))
    n = c.union(table(spark, d, "supplier").select(F.lit("supplier"), F.col("s_suppkey"), F.lower("s_name")))
    qs = ("customer#000000012", "custmer#000000077", "suplier#000000003")
    n = n.select("*", F.explode(F.array(*map(F.lit, qs))).alias("q"))
    edits = F.levenshtein(F.col("t"), F.col("q"), 2)
    score = F.when(F.col("t") == F.col("q"), 160).when(F.startswith("t", F.col("q")), 125).when(F.contains("t", F.col("q")), 105).when(edits >= 0, 95 - 10 * edits)
    return top_per_group(n.withColumn("score", score.cast("long")).where("score IS NOT NULL"), ["q"], [F.desc("score"), F.col("kind"), F.col("key")], 10).select("q", "kind", "key", "score")


ROBOTS = [("allow", "/en/"), ("disallow", "/en/7"), ("disallow", "/fr/*1$"), ("disallow", "/de/"), ("allow", "/de/*5")]


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages), r(verdict, pattern, regex) AS (VALUES ('allow', '/en/', '^/en/'), ('disallow', '/en/7', '^/en/7'), ('disallow', '/fr/*1$', '^/fr/.*1$'), ('disallow', '/de/', '^/de/'), ('allow', '/de/*5', '^/de/.*5')),
m AS (SELECT page_id, max(CASE WHEN verdict = 'allow' THEN length(rtrim(pattern, '$')) ELSE -1 END) AS a, max(CASE WHEN verdict = 'disallow' THEN length(rtrim(pattern, '$')) ELSE -1 END) AS x FROM p JOIN r ON regexp_matches(path, regex) GROUP BY 1)
SELECT p.page_id, path, coalesce(a >= x, true) AS allowed FROM p LEFT JOIN m USING (page_id)""")
def robots_longest_match(spark: SparkSession, d: str) -> DataFrame:
    """The longest rule decides, allow wins ties; rules are a given list, so they are one expression per row."""
    path = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    p = table(spark, d, "pages").select("page_id", path.alias("path"))
    return p.select("page_id", "path", robots_verdict(F.col("path"), ROBOTS).alias("allowed"))


@query(r"""SELECT doc_id, round(length(regexp_replace(text, '[^\p{Han}]', '', 'g')) / greatest(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 1)::DOUBLE, 6) AS han, round(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / greatest(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 1)::DOUBLE, 6) AS latin FROM documents""")
def language_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of Han and of plain Latin letters among all letters."""
    return docs(spark, d).select("doc_id", F.round(letter_share(F.col("text"), r"\p{IsHan}"), 6).alias("han"), F.round(letter_share(F.col("text"), "A-Za-z"), 6).alias("latin"))


@query(r"""SELECT conv_id, turn, sha256(concat('{"role":"', role, '","turn":', turn, '}')) AS fingerprint FROM conversations""")
def request_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Hash of a request's key-sorted JSON."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(F.to_json(F.struct("role", "turn")), 256).alias("fingerprint"))


@query("""WITH t AS (SELECT conv_id, turn, ceil(length(text) / 4.0::DOUBLE)::BIGINT AS tokens FROM conversations), r AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM t) SELECT conv_id, turn, tokens, used::BIGINT AS used FROM r WHERE used <= 800""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """The newest turns of a conversation that fit 800 tokens (a fourth of the characters each)."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.ceil(F.length("text") / F.lit(4.0)).cast("long").alias("tokens"))
    r = t.withColumn("used", F.sum("tokens").over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    return r.where("used <= 800")


@query(r"""WITH s AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(left(text, 80)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM documents) SELECT doc_id, left(slug, 40) || '-' || left(sha256(doc_id::VARCHAR), 8) AS slug FROM s""")
def slug_with_digest(spark: SparkSession, d: str) -> DataFrame:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.left("text", F.lit(80))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return docs(spark, d).select("doc_id", F.concat(F.left(s, F.lit(40)), F.lit("-"), F.left(F.sha2(F.col("doc_id").cast("string"), 256), F.lit(8))).alias("slug"))


@query(r"""SELECT conv_id, turn, length(text) + len(regexp_extract_all(text, '[\p{Han}]')) AS weight, CASE WHEN length(text) > 120 THEN left(text, 119) || '…' ELSE text END AS short FROM conversations""")
def weighted_length(spark: SparkSession, d: str) -> DataFrame:
    """Length with Han letters counted twice, and the text cut to 120 characters."""
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", (F.length("text") + F.regexp_count("text", F.lit(r"\p{IsHan}"))).cast("long").alias("weight"), F.when(F.length("text") > 120, F.concat(F.left("text", F.lit(119)), F.lit("…"))).otherwise(F.col("text")).alias("short"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, len(regexp_extract_all(html, '<a [^>]*href="')) ::INT AS links, regexp_extract(html, '<a [^>]*href="([^"#?]*)', 1) AS first_link FROM pages""")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    """Title, number of links and first link of a page."""
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.regexp_count("html", F.lit('<a [^>]*href="')).alias("links"),
                                           F.get(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"#?]*)'), 1), F.lit(0)).alias("first_link"))


@query()
def html_article(spark: SparkSession, d: str) -> DataFrame:
    """Article text and segments of a page."""
    from lodestream.sources.html import article

    return article(table(spark, d, "pages"))


@query()
def html_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rectangular grids of the tables of a page."""
    from lodestream.sources.html import tables

    return tables(table(spark, d, "pages"))


AGENTS = ["Mozilla/5.0 (Windows NT 10.0) Chrome/120", "Googlebot/2.1", "curl/8.0", "UptimeRobot/2.0", "Mozilla/5.0 (iPhone) Safari/604", "python-requests/2.31", "Mozilla/5.0 (Macintosh) Firefox/121"]


@query("SELECT event_id, CASE event_id % 7 WHEN 1 THEN 'crawler' WHEN 2 THEN 'tool' WHEN 3 THEN 'monitor' WHEN 5 THEN 'tool' ELSE 'human' END AS class, CASE event_id % 7 WHEN 0 THEN 'Chrome' WHEN 4 THEN 'Safari' WHEN 6 THEN 'Firefox' ELSE 'other' END AS browser FROM events")
def user_agent_class(spark: SparkSession, d: str) -> DataFrame:
    """Classes from ordered patterns; the first that fits counts."""
    ua = F.element_at(F.array(*map(F.lit, AGENTS)), (F.col("event_id") % 7 + 1).cast("int"))
    e = table(spark, d, "events").select("event_id", ua.alias("ua"))
    low = F.lower("ua")
    kind = F.when(low.rlike("bot/|crawl|spider") & ~low.rlike("uptime"), "crawler").when(low.rlike("uptime|pingdom|monitor"), "monitor").when(low.rlike("curl|wget|python-requests|httpclient"), "tool").otherwise("human")
    browser = F.when(low.rlike("chrome/"), "Chrome").when(low.rlike("firefox/"), "Firefox").when(low.rlike("safari/"), "Safari").otherwise("other")
    return e.select("event_id", kind.alias("class"), browser.alias("browser"))
