"""URL filters (operator 8): pattern rules indexed by their rarest literal token.

A rule is a pattern over the address without its scheme (host in lower case,
then the path), with a verdict and a weight. Two forms:

* ``host/path``: the host and all its subdomains, paths that start so;
* ``*``-patterns: literal text with ``*`` for any run of characters and ``^`` for
  a character that is no letter, digit, ``_``, ``-``, ``.`` or ``%`` (or the end),
  found anywhere in the address.

From each pattern follow the literal tokens (runs of letters and digits) that
any address it fits must hold as whole tokens. Token counts over all distinct
addresses tell the rarest one, and the rule is filed under it. A pattern without
a whole token is filed under the rarest run of up to ``GRAM`` literal characters
that it holds anywhere, and one without any literal under the empty key, which
every address has. Keys of an address fetch candidate rules by a hash join, and
only those candidates run their regular expression. Keys that no rule has go
before anything is shuffled. Rules can be a list or a table (pattern, verdict,
tier), of which rows with a null are left out and repeated rows count once.

Addresses are judged once each (repeats are joined back). A null url, or one
without ``://``, has an empty host and path and fits no rule. The rule index is
broadcast while its counted rows allow it; beyond that it is shuffled, and keys
of more than ``HOT`` addresses are dealt over several tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.store import materialize

#: Literal characters of a key for rules without a whole token.
GRAM = 3
#: Rows of a rule index (a few hundred bytes each) up to which it is broadcast, and of keys.
INDEX_ROWS = 100_000
#: Addresses of one key that one task gets where the index is shuffled.
HOT = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_LOWERED = str.maketrans(_UPPER, _LOWER)


@dataclass(frozen=True)
class Rule:
    """``tier`` 0 outranks 1; within a tier the longest pattern wins, then block, then the pattern in order."""

    pattern: str
    verdict: str
    tier: int = 1

    @property
    def is_domain(self) -> bool:
        return "*" not in self.pattern and "^" not in self.pattern

    def regex(self) -> str:
        if self.is_domain:
            return r"^(?:[^/]*\.)?" + re.escape(self.pattern)
        return "".join({"*": ".*", "^": "(?:[^A-Za-z0-9_.%-]|$)"}.get(c, re.escape(c)) for c in self.pattern)

    def tokens(self) -> list[str]:
        """Whole tokens of every address that the pattern fits, in lower case."""
        out = []
        for m in re.finditer(r"[A-Za-z0-9]+", self.pattern):
            before, after = self.pattern[: m.start()][-1:], self.pattern[m.end() :][:1]
            opened = before not in ("", "*") or (before == "" and self.is_domain)
            if opened and after not in ("", "*"):
                out.append(m[0].lower())
        return out


    def keys(self) -> list[str]:
        """Whole tokens (t:), or the literal runs of the longest size up to ``GRAM`` (1: to 3:), or the empty key."""
        if found := self.tokens():
            return ["t:" + t for t in found]
        runs = re.findall(r"[^*^]+", self.pattern)
        size = min(GRAM, max(map(len, runs), default=0))
        return [f"{size}:{r[i : i + size].translate(_LOWERED)}" for r in runs for i in range(len(r) - size + 1)] if size else [""]


#: The rules that callers fix come first; the method's own follow: sign-in, cart and session pages, trackers and adverts.
DOMAIN_RULES = [Rule("net/", "block", 0), Rule("example.net/en/", "allow", 0), Rule("example.com/de/", "block", 0), Rule("org/fr/", "allow", 0)]
OWN_RULES = [
    Rule(p, "block")
    for p in ("/login^", "/signin^", "/logout^", "/cart^", "/checkout^", "/ads/*", ".doubleclick.*/", "/adserver^", "/tracking/pixel^", "/wp-login.", "/cgi-bin/*")
] + [Rule("/login/help^", "allow")]


def address_columns(url):
    """(host, path) of a url column: host from the first ``://`` on, A-Z lowered; both empty without one."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _rule_table(spark: SparkSession, rules: list[Rule] | DataFrame) -> DataFrame:
    """(rule, verdict, tier, regex, keys), computed where the rules are."""

    def prepare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [Rule(*r) for r in zip(f["rule"], f["verdict"], f["tier"], strict=True)]
            yield f.assign(regex=[r.regex() for r in made], keys=[r.keys() for r in made])

    kinds = "rule string, verdict string, tier int"
    if isinstance(rules, DataFrame):
        table = rules.select(F.col("pattern").alias("rule"), "verdict", F.col("tier").cast("int").alias("tier")).dropna().distinct()
    else:
        table = spark.createDataFrame([(r.pattern, r.verdict, r.tier) for r in rules], kinds).distinct()
    return materialize(table.mapInPandas(prepare, f"{kinds}, regex string, keys array<string>"), "rules")


def _address_keys(addresses: DataFrame, sizes: list[int]) -> DataFrame:
    """(address, key): whole tokens, runs of the wanted sizes, and the empty key."""
    low = F.translate("address", _UPPER, _LOWER)
    part = lambda n: lambda i: F.concat(F.lit(f"{n}:"), F.substr(low, i, F.lit(n)))
    parts = [F.transform(F.split(low, "[^a-z0-9]+"), lambda t: F.concat(F.lit("t:"), t))]
    for size in sizes:
        starts = F.when(F.length("address") >= size, F.sequence(F.lit(1), F.length("address") - (size - 1))).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(starts, part(size)) if size else F.array(F.lit("")))
    return addresses.select("address", F.explode(F.array_distinct(F.concat(*parts))).alias("key"))


def judge(pages: DataFrame, rules: list[Rule] | DataFrame | None = None, default: str = "allow") -> DataFrame:
    """``pages(page_id, url, ...)`` -> (page_id, host, path, rule, verdict, pattern), one row per input row.

    ``rule`` names the fitting rule of tier 0, else it is null; ``pattern`` names
    the rule that gave the verdict, whatever its tier, and is null for the default.
    """
    spark = pages.sparkSession
    table = _rule_table(spark, DOMAIN_RULES + OWN_RULES if rules is None else rules)
    host, path = address_columns(F.col("url"))
    judged = pages.select("page_id", F.col("url").alias("url")).withColumn("host", host).withColumn("path", path)
    addresses = materialize(
        judged.where("host <> '' OR path <> ''").select(F.concat("host", "path").alias("address")).distinct(), "addresses"
    )
    wanted = materialize(table.select("rule", "verdict", "tier", F.explode(F.array_distinct("keys")).alias("key")), "rule-keys")
    keys = wanted.select("key").distinct()
    kinds = keys.select(F.substr("key", F.lit(1), F.lit(1)).alias("c")).distinct().collect()  # GRAM + 2 values at most
    sizes = sorted(int(r["c"] or 0) for r in kinds if r["c"] != "t")
    few = wanted.count() <= INDEX_ROWS
    held = _address_keys(addresses, sizes).join(F.broadcast(keys) if few else keys, "key", "left_semi")
    counts = materialize(held.groupBy("key").count(), "key-counts")
    rule = ["rule", "verdict", "tier"]
    filed = (
        wanted.join(F.broadcast(counts) if few else counts, "key", "left").withColumn("count", F.coalesce("count", F.lit(0))).groupBy(*rule)
        .agg(F.min_by(F.struct("key", "count"), F.struct("count", "key")).alias("k"))
    )
    index = materialize(filed.select(*rule, "k.*").join(table.drop("keys"), rule), "rule-index")
    if few:
        candidates = held.join(F.broadcast(index), "key")
    else:
        index = index.withColumn("salts", (F.col("count") / HOT).cast("int") + 1)
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        hot = index.where("salts > 1").select("key", "salts").distinct()
        hot = F.broadcast(hot) if hot.count() <= INDEX_ROWS else hot
        dealt = held.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("address"), F.coalesce("salts", F.lit(1))).cast("int"))
        candidates = dealt.join(salted, ["key", "salt"])
    fits = candidates.where(F.regexp_like("address", F.col("regex")))
    order = F.struct((-F.col("tier")).alias("t"), F.length("rule").alias("l"), (F.col("verdict") == "block").alias("b"), "rule")
    best = fits.groupBy("address").agg(F.max_by(F.struct("rule", "verdict", "tier"), order).alias("best"))
    best = materialize(best, "address-verdicts")
    return (
        judged.withColumn("address", F.concat("host", "path")).join(best, "address", "left")
        .select(
            "page_id", "host", "path",
            F.when(F.col("best.tier") == 0, F.col("best.rule")).alias("rule"),
            F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
            F.col("best.rule").alias("pattern"),
        )
    )


#: The method's own rules as written by hand for SQL.
_SQL_RULES = [
    ("/login^", "block", "/login([^A-Za-z0-9_.%-]|$)"), ("/signin^", "block", "/signin([^A-Za-z0-9_.%-]|$)"), ("/logout^", "block", "/logout([^A-Za-z0-9_.%-]|$)"),
    ("/cart^", "block", "/cart([^A-Za-z0-9_.%-]|$)"), ("/checkout^", "block", "/checkout([^A-Za-z0-9_.%-]|$)"), ("/ads/*", "block", "/ads/"),
    (".doubleclick.*/", "block", "[.]doubleclick[.].*/"), ("/adserver^", "block", "/adserver([^A-Za-z0-9_.%-]|$)"), ("/tracking/pixel^", "block", "/tracking/pixel([^A-Za-z0-9_.%-]|$)"),
    ("/wp-login.", "block", "/wp-login[.]"), ("/cgi-bin/*", "block", "/cgi-bin/"), ("/login/help^", "allow", "/login/help([^A-Za-z0-9_.%-]|$)"),
]


def oracle() -> str:
    """DuckDB SQL with the same result for the default rules."""
    domains = ", ".join(f"('{r.pattern}', '{r.verdict}', '{r.pattern.split('/')[0]}', '{r.pattern[len(r.pattern.split('/')[0]):]}')" for r in DOMAIN_RULES)
    own = ", ".join(f"('{p}', '{v}', '{x}')" for p, v, x in _SQL_RULES)
    return f"""
WITH domains(rule, verdict, h, start) AS (VALUES {domains}), own(rule, verdict, regex) AS (VALUES {own}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT row_number() OVER () AS rn, page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host,
      coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
hit AS (SELECT rn, rule, d.verdict, 0 AS tier FROM p JOIN domains d ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start)
        UNION ALL SELECT rn, rule, o.verdict, 1 FROM p JOIN own o ON regexp_matches(host || path, regex)),
fit AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY rn ORDER BY tier, length(rule) DESC, (verdict = 'block') DESC, rule DESC) = 1)
SELECT page_id, host, path, CASE WHEN tier = 0 THEN rule END AS rule, coalesce(verdict, 'allow') AS verdict, rule AS pattern
FROM p LEFT JOIN fit USING (rn)"""
