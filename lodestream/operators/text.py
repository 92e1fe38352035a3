"""Text operators as column expressions: addresses, keys, gates, similarity, robots rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Topics and the patterns that name them.
TOPICS = {"links": r"https?://", "licence": "licensed under", "mail": "[a-z0-9.]+@[a-z0-9]+", "english": "(^|[^a-z])the([^a-z]|$)", "german": "(^|[^a-z])und([^a-z]|$)", "french": "(^|[^a-z])les([^a-z]|$)", "spanish": "(^|[^a-z])los([^a-z]|$)"}


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def canonical_url(url: Column) -> Column:
    """https, no ``www.``/``m.``/``amp.`` host prefix, no amp or trailing slash, no fragment, no tracking parameters, the rest sorted."""
    origin = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*", 0))
    origin = F.regexp_replace(F.regexp_replace(origin, "^http:", "https:"), r"://(www|m|amp)\.", "://")
    base = F.concat(origin, F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1))
    base = F.regexp_replace(F.regexp_replace(base, "/amp/?$", "/"), "(.)/+$", "$1")
    kept = F.sort_array(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|fbclid|gclid)=")))
    return F.concat(base, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.concat_ws("&", kept))).otherwise(F.lit("")))


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N} ]", " "), " +", " "))


def content_key(text: Column) -> Column:
    """Hash of the first 2,000 letters, digits and blanks, as the reference defines a content hash."""
    return F.sha1(F.left(_plain(text), F.lit(2000)).cast("binary"))


def title_key(text: Column, source: Column, lang: Column) -> Column:
    """Hash of the head of a text with its source and language."""
    return F.sha1(F.concat(_plain(F.left(text, F.lit(60))), F.lit("|"), source, F.lit("|"), lang).cast("binary"))


def letter_share(text: Column, letters: str) -> Column:
    """Share of a class of letters among all letters."""
    return F.length(F.regexp_replace(text, f"[^{letters}]+", "")) / F.greatest(F.length(F.regexp_replace(text, r"[^\p{L}]+", "")), F.lit(1))


def sentences(text: Column) -> Column:
    """Sentences, not split after common abbreviations or initials."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])(?<!\b(?:Mr|Dr|vs|etc|No|St)\.)(?<!\b[A-Z]\.)\s+|\n+"), F.trim), lambda s: s != "")


def bigram_dice(a: Column, b: Column) -> Column:
    """Twice the shared bigrams (as multisets) over all bigrams."""
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))
    count = lambda xs, g: F.size(F.filter(xs, lambda y: y == g))
    x, y = grams(a), grams(b)
    shared = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda s, g: s + F.least(count(x, g), count(y, g)))
    return 2.0 * shared / (F.size(x) + F.size(y))


def wildcard_regex(pattern: str) -> str:
    """Regular expression of a robots pattern: ``*`` any run, a final ``$`` the end, otherwise a prefix."""
    body, end = (pattern[:-1], "$") if pattern.endswith("$") else (pattern, "")
    return "^" + ".*".join(re.escape(p) for p in body.split("*")) + end


def robots_verdict(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether a path is allowed: the longest fitting pattern decides, allow wins ties, no pattern allows."""
    fits = lambda p: F.when(path.rlike(wildcard_regex(p)), len(p.removesuffix("$"))).otherwise(-1)
    best = {v: F.array_max(F.array(F.lit(-1), *[fits(p) for w, p in rules if w == v])) for v in ("allow", "disallow")}
    return (best["allow"] >= best["disallow"])
