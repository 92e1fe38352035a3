"""The publication gate: what keeps an article out of a listing, and verdicts stored so that reads need no texts.

An article has (title, text, url, language), an analysis (summary, summary_zh,
review_status; all null without one) and a translation (translation_title,
translation_text; both null without one). The gate gives an ordered list of
issue codes for the English and for the Chinese page. Verdicts are stored with
the version of the rules and a digest of what the gate reads; a refresh computes
those rows only whose digest or rules have changed, removes those whose article
is gone, and leaves all other files alone.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.scalar import bound
from lodestream.sources.versioned import VersionedTable

# Titles and bodies that are no article, broken compounds, broken encodings.
BARE_TITLES = ["untitled", "title", "document", "report", "research", "go to article", "无标题"]
FILE_WORDS = ["pdf", "document", "attachment", "file"]
OPENING_VERBS = ["download", "view", "open", "read", "get", "fetch", "see"]
PLACEHOLDERS = ["即将发布", "敬请期待"]
COMPOUNDS = ["viewpoint", "investment", "institution", "institutional", "research", "outlook", "forecast", "consensus", "economics", "strategy"]
MOJIBAKE = r"\x{FFFD}|Ã.|Â.|â€"
INPUTS = ["title", "text", "url", "language", "summary", "summary_zh", "review_status", "translation_title", "translation_text"]

_any = "|".join
NOISE = _any([
    f"^({_any(BARE_TITLES)}|download( the)? (pdf|report|document))$",
    rf"^({_any(FILE_WORDS)})\b",
    rf"^({_any(OPENING_VERBS)})\s+((the|this)\s+)?({_any(FILE_WORDS)})\b",
    r"\b(of entire text|full document|entire document)\b",
    r"uploaded (document|file)",
    r"^untitled\b",
    r"\b(pdf|document|file)\b[^a-z]{0,20}\b\d+\s*(kb|mb|k|m)\b",
])
SOON_TITLE = rf"^((article\s+)?coming\s+soon|(文章|内容)?{PLACEHOLDERS[0]}|{PLACEHOLDERS[1]})$"
SOON_BODY = rf"\barticle\s+coming\s+soon\b|(文章|内容){PLACEHOLDERS[0]}|{PLACEHOLDERS[1]}"


def _bare(text: Column) -> Column:
    """Without white space at its ends; null as empty."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)^\s*+(.*\S)?", 1)


def _count(text: Column, letters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{letters}]+", ""))


def native_chinese(title: Column, text: Column, language: Column) -> Column:
    """Written in Chinese: by its language, or by a fifth of the letters of title and first 2,000 characters (20 letters at least)."""
    sample = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.left(F.coalesce(text, F.lit("")), F.lit(2000)))
    letters, han = _count(sample, r"\p{L}"), _count(sample, r"\p{IsHan}")
    return F.coalesce(F.lower(_bare(language)).rlike(r"^zh\b"), F.lit(False)) | ((letters >= 20) & (han >= letters * 0.2))


def broken_word(text: Column) -> Column:
    """Whether two to five neighbouring words spell a known compound, one of them of two letters at most."""
    known = F.array(*map(F.lit, COMPOUNDS))

    def found(words: Column) -> Column:
        def at(i: Column) -> Column:
            return F.exists(F.sequence(F.lit(2), F.lit(5)), lambda n: (i + n <= F.size(words)) & F.array_contains(known, F.array_join(F.slice(words, i + 1, n), "")) & F.exists(F.slice(words, i + 1, n), lambda w: F.length(w) <= 2))

        return F.when(F.size(words) > 1, F.exists(F.sequence(F.lit(0), F.size(words) - 2), at)).otherwise(F.lit(False))

    squeezed = F.regexp_replace(F.lower(text), "[^a-z]+", "")
    spelled = reduce(or_, [F.contains(squeezed, F.lit(c)) for c in COMPOUNDS])  # few texts spell one at all
    return F.when(spelled, bound(F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != ""), found)).otherwise(F.lit(False))


def noise_title(title: Column) -> Column:
    """A caption, a size or too few letters instead of a headline."""
    low = F.lower(title)
    return low.rlike(NOISE) | (~title.rlike(r"\p{IsHan}") & (_count(title, r"\p{L}") < 6))


def _ends(of: dict[str, Column]) -> dict[str, Column]:
    return {"title": _bare(of["title"]), "body": _bare(of["text"]), "native": native_chinese(of["title"], of["text"], of["language"])}


def _judged(title: Column, body: Column) -> dict[str, Column]:
    head = F.concat(title, F.lit("\n"), F.left(body, F.lit(5000)))
    return {
        "abnormal": (F.length(title) < 8) | (F.length(title) > 180) | noise_title(title),
        "placeholder": F.lower(title).rlike(SOON_TITLE) | F.lower(F.left(body, F.lit(2000))).rlike(SOON_BODY),
        "garbled": head.rlike(MOJIBAKE) | broken_word(head),
    }


def with_facts(articles: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """``articles(INPUTS...)`` with columns for what both pages' issues ask, each computed once a row, and those columns by name."""
    ends = _ends({c: F.col(c) for c in INPUTS})
    rows = articles.withColumns({f"_{c}": x for c, x in ends.items()})
    judged = _judged(F.col("_title"), F.col("_body"))
    return rows.withColumns({f"_{c}": x for c, x in judged.items()}), {c: F.col(f"_{c}") for c in ends | judged}


def gate_issues(locale: str, facts: dict[str, Column] | None = None, **given: Column) -> Column:
    """Issue codes for ``locale`` (``en`` or ``zh-CN``), in a fixed order; missing inputs count as null. ``facts`` are those of :func:`with_facts`."""
    of = {c: given.get(c, F.lit(None).cast("string")) for c in INPUTS}
    fact = facts or _ends(of)
    title, body, native = fact["title"], fact["body"], fact["native"]
    fact = facts or fact | _judged(title, body)
    chinese = locale == "zh-CN"
    own, zh = _bare(of["summary"]), _bare(of["summary_zh"])
    opening = F.regexp_replace(F.regexp_replace(F.coalesce(of["translation_text"], F.lit("")), "(?m)^#{1,6}[^\n]*$", ""), r"(?m)^[-*•]\s+", "")
    summary = F.when(native, F.concat(zh, own)).otherwise(F.concat(zh, _bare(opening))) if chinese else own
    translated = of["translation_title"].isNotNull() | of["translation_text"].isNotNull()
    both = F.concat(F.coalesce(of["translation_title"], F.lit("")), F.lit("\n"), F.coalesce(of["translation_text"], F.lit("")))
    needs = ~native if chinese else F.lit(False)
    rules = [
        ("abnormal_title", fact["abnormal"]),
        ("placeholder_content", fact["placeholder"]),
        ("garbled_or_broken_words", fact["garbled"]),
        ("thin_content", F.length(body) < 300),
        ("empty_summary", summary == ""),
        ("missing_source", ~F.lower(F.coalesce(of["url"], F.lit(""))).rlike("^https?://")),
        ("source_language_mismatch", of["language"].eqNullSafe(F.lit("en")) & title.rlike(r"\p{IsHan}") & ~native),
        ("analysis_needs_review", F.coalesce(of["review_status"] != "ok", F.lit(False))),
        ("missing_translation", needs & ((_bare(of["translation_title"]) == "") | (_bare(of["translation_text"]) == ""))),
        ("translation_language_mismatch", needs & translated & ~both.rlike(r"\p{IsHan}")),
        ("translation_garbled", needs & translated & (both.rlike(MOJIBAKE) | broken_word(both))),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in rules]))


def eligibility(title: Column, text: Column, url: Column, issues: Column) -> Column:
    """NOT_GENERATED without title, text or address; else by whether there are issues."""
    missing = (_bare(title) == "") | (_bare(text) == "") | (F.coalesce(url, F.lit("")) == "")
    return F.when(missing, "NOT_GENERATED").when(F.size(issues) > 0, "NOINDEX_FOLLOW").otherwise("INDEX")


# --- stored verdicts ------------------------------------------------------------------------------

VERDICT = "digest string, rules int, issues_en array<string>, issues_zh array<string>, indexable_en boolean, indexable_zh boolean"


def input_digest() -> Column:
    """A digest of all that the gate reads; null and empty differ."""
    return F.sha2(F.to_json(F.struct(*INPUTS), {"ignoreNullFields": "false"}).cast("binary"), 256)


def verdicts(articles: DataFrame, key: str, rules: int) -> DataFrame:
    """``articles(key, INPUTS...)`` with the columns of VERDICT."""
    given = {c: F.col(c) for c in INPUTS}
    seen, facts = with_facts(articles)
    rows = seen.select(
        key, input_digest().alias("digest"), F.lit(rules).alias("rules"), gate_issues("en", facts, **given).alias("issues_en"), gate_issues("zh-CN", facts, **given).alias("issues_zh"),
        ((facts["title"] == "") | (facts["body"] == "") | (F.coalesce("url", F.lit("")) == "")).alias("_missing"),
    )
    ready = lambda c: (F.size(c) == 0) & ~F.col("_missing")
    return rows.select("*", ready("issues_en").alias("indexable_en"), ready("issues_zh").alias("indexable_zh")).drop("_missing")


def refresh_verdicts(store: VersionedTable, articles: DataFrame, key: str, rules: int) -> int:
    """Bring the stored verdicts up to date with ``articles(key, INPUTS...)``, keys distinct and not null.

    Returns how many rows were computed: none where neither inputs nor rules have changed. The first call makes
    the table. Files of unchanged verdicts keep their names.
    """
    articles = articles.select(key, *INPUTS)
    if store.version() < 0:
        store.create(verdicts(articles, key, rules), [key])
        return store.read().count()
    known = store.read().select(F.col(key).alias("_k"), F.col("digest").alias("_digest"), F.col("rules").alias("_rules"))
    held = articles.withColumn("_d", input_digest()).join(known, F.col(key) == F.col("_k"), "left")
    changed = held.where(~F.col("_digest").eqNullSafe(F.col("_d")) | ~F.col("_rules").eqNullSafe(F.lit(rules))).select(key, *INPUTS)
    before = set(store.files())
    store.upsert(verdicts(changed, key, rules), [key])
    computed = _computed(store, [f for f in store.files() if f not in before], known, key)
    gone = store.read().join(articles.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti").select(key)
    store.delete_where(F.lit(True), gone.withColumnRenamed(key, "_g"), {key: "_g"})
    return computed


def _computed(store: VersionedTable, fresh: list[str], known: DataFrame, key: str) -> int:
    """Rows of the new files that differ from what was stored before."""
    if not fresh:
        return 0
    rows = store.read(files=fresh).join(known, F.col(key) == F.col("_k"), "left")
    return rows.where(~F.col("_digest").eqNullSafe(F.col("digest")) | ~F.col("_rules").eqNullSafe(F.col("rules"))).count()
