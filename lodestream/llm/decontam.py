"""Benchmark decontamination (operator 3), native: template canonicalisation and a hash join of template windows.

Numbers, names and units of a text become typed placeholders, so a benchmark
question whose values were changed still has the same template:

* a number is a run of digits with inner separators;
* a unit is one of ``UNITS`` one blank after a number;
* a name is a capitalised word that follows, after one blank, a lower-case
  letter, digit, comma or semicolon (so not the first word of a sentence).

Case and punctuation go. Windows of ``WINDOW`` words (all windows of all whole
texts) are joined by hash with the benchmark's: windows of template words, for
questions with other values, and windows of plain words, for copies whose case
or line breaks change what a word looks like. Template windows with fewer literal
words than half say too little and count as plain ones only. Every alignment of a
text and an item that shares a window is compared word by word, and its slots
must be consistent: equal values in the item stand for equal values in the
document, and the reverse. A pair is contaminated if an alignment is consistent
and at least half of the item's words, or ``ENOUGH`` words, agree; or if the
windows of consistent alignments less than ``NEAR`` words apart (words were put
in or left out) cover as many.

Items of ``LEAST`` to ``WINDOW - 1`` words are one window of their own length.
Shorter items match texts that consist of just their words. Null or empty texts,
items without words and rows with a null id match nothing. Texts that share an id
are judged one by one; a pair gets its best alignment over all of them, repeated
rows count once. Only DataFrame functions run; the benchmark's windows are
broadcast only if their counted number allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.store import BROADCAST_KEYS, keys_hint, materialize

WINDOW, LEAST, ENOUGH, NEAR = 8, 5, 20, 16
UNITS = "km|kg|cm|mm|mg|ml|m|g|l|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|euros?|percent|miles?|feet|meters?|metres?|pounds?|tons?"

#: (pattern, replacement with $-groups) in order; lower-casing comes before the last one.
_MARKING = [
    (r"([0-9])[.,:/]([0-9])", "$1x$2"),
    (r"([0-9])[.,:/]([0-9])", "$1x$2"),
    (rf"([0-9] )({UNITS})([^\p{{L}}\p{{N}}]|$)", "$1u0$2$3"),
    (r"([\p{Ll}\p{N},;] )(\p{Lu}\p{Ll}+)", "$1n0$2"),
    (r"([\p{Ll}\p{N},;] )(\p{Lu}\p{Ll}+)", "$1n0$2"),
]
_STRIP = (r"[^\p{L}\p{N}]+", "  ")
#: On a text with two blanks around every word.
_PLAIN = ("(  )[nu]0([^ ])", "$1$2")
_TYPING = [(" ([nu])0[^ ]* ", " $10 "), (" [0-9][0-9x]* ", " 0 ")]


def _marked(text: Column) -> Column:
    """Lower-case words with two blanks between; names start with n0, units with u0, numbers with a digit."""
    for pattern, new in _MARKING:
        text = F.regexp_replace(text, pattern, new)
    return F.concat(F.lit("  "), F.regexp_replace(F.lower(text), *_STRIP), F.lit("  "))


def _template(marked: Column) -> Column:
    for pattern, new in _TYPING:
        marked = F.regexp_replace(marked, pattern, new)
    return marked


def _words(marked: Column) -> Column:
    return F.split(F.trim(marked), "  +")


def _texts(rows: DataFrame) -> DataFrame:
    """``rows`` with ``text`` replaced by its ``plain`` and its template ``words``, as many of either."""
    rows = rows.withColumn("m", _marked(F.col("text"))).drop("text")
    return rows.withColumn("plain", _words(F.regexp_replace("m", *_PLAIN))).withColumn("words", _words(_template(F.col("m")))).drop("m")


def _hashed(rows: DataFrame, words: str, sizes: list[int], seed: int) -> DataFrame:
    """``rows`` with a column ``{words}_{size}`` of the hashes of all windows of each size; null for shorter texts.

    Each word is hashed once; windows of 2, 4 and 8 words come from two halves.
    """
    name = lambda k: f"{words}_h{k}"
    pair = lambda a, b: F.xxhash64(a, b)
    later = lambda c, n: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    rows, k = rows.withColumn(name(1), F.transform(words, lambda w: F.xxhash64(w, F.lit(seed)))), 1
    made = [name(1)]
    while 2 * k <= max(sizes):
        rows = rows.withColumn(name(2 * k), F.zip_with(name(k), later(name(k), k), pair))
        made.append(name(2 * k))
        k *= 2
    for size in sizes:
        window, at = None, 0
        for k in (8, 4, 2, 1):
            if size & k:
                window = F.col(name(k)) if window is None else F.zip_with(window, later(name(k), at), pair)
                at += k
        rows = rows.withColumn(f"{words}_{size}", F.when(F.size(words) >= size, F.slice(window, 1, F.greatest(F.size(words) - (size - 1), F.lit(0)))))
    return rows.drop(*made)


def _is_slot(word: Column) -> Column:
    return word.isin("n0", "u0", "0")


def _enough(words: Column, of: Column) -> Column:
    return (words * 2 >= of) | (words >= ENOUGH)


def _short_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Items under ``LEAST`` words and the texts that are just their words."""
    short = items.where(F.size("plain") < LEAST).select("item_id", "plain")
    hinted = F.broadcast(short) if short.count() <= BROADCAST_KEYS else short
    same = _texts(docs).where(F.size("plain") < LEAST).join(hinted, "plain").select("doc_id", "item_id", F.size("plain").alias("n")).distinct()
    yes, n = F.lit(True), F.col("n")
    return same.select("doc_id", "item_id", F.lit(1).cast("long").alias("windows"), n.alias("same_words"), n.alias("joint_words"), n.alias("item_words"),
                       F.lit(0).alias("slots"), yes.alias("consistent"), yes.alias("exact"), yes.alias("contaminated"))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` and ``benchmark(item_id, text)`` -> one row per pair that shares a window:
    (doc_id, item_id, windows, same_words, joint_words, item_words, slots, consistent, exact, contaminated)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    items = _texts(benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL"))
    items = materialize(items.where("plain[0] <> ''").withColumn("size", F.least(F.size("words"), F.lit(WINDOW))), "items")
    found = {r["size"] for r in items.select("size").distinct().collect()}  # WINDOW values at most
    sizes = sorted(s for s in found if s >= LEAST)
    short = _short_pairs(docs, items) if found - set(sizes) else None
    if not sizes:
        none = _short_pairs(docs.where("false"), items)
        return none if short is None else short
    spots = None
    for size in sizes:
        hashed = _hashed(_hashed(items.where(F.col("size") == size), "words", [size], 0), "plain", [size], 1)
        literal = F.size(F.filter(F.slice("words", F.col("ipos") + 1, size), lambda w: ~_is_slot(w))) * 2 >= size
        part = hashed.select("item_id", "size", "words", F.posexplode(f"words_{size}").alias("ipos", "h")).where(literal).select("h", "item_id", "ipos", "size")
        part = part.union(hashed.select("item_id", "size", F.posexplode(f"plain_{size}").alias("ipos", "h")).select("h", "item_id", "ipos", "size"))
        spots = part if spots is None else spots.union(part)
    spots = materialize(spots, "item-windows")
    opened = _texts(docs.withColumn("tid", F.xxhash64("text")))
    opened = _hashed(_hashed(opened, "words", sizes, 0), "plain", sizes, 1)
    if len(sizes) == 1:
        kinds, n = (f"words_{sizes[0]}", f"plain_{sizes[0]}"), F.size(f"words_{sizes[0]}")
        opened = opened.select("doc_id", "tid", n.alias("n"), F.posexplode(F.concat(*kinds)).alias("pos", "h"))
        opened = opened.select("doc_id", "tid", "h", (F.col("pos") % F.col("n")).alias("pos"))
    else:  # windows of several sizes, each with its place in the text
        none = F.array().cast("array<bigint>")
        each = [F.transform(F.coalesce(f"{kind}_{s}", none), lambda h, i: F.struct(i.alias("pos"), h.alias("h"))) for kind in ("words", "plain") for s in sizes]
        opened = opened.select("doc_id", "tid", F.explode(F.concat(*each)).alias("w")).select("doc_id", "tid", "w.h", "w.pos")
    hinted = F.broadcast(spots) if spots.count() <= BROADCAST_KEYS else spots
    hits = materialize(
        opened.join(hinted, "h").groupBy("doc_id", "tid", "item_id", (F.col("pos") - F.col("ipos")).alias("shift"))
        .agg(F.sort_array(F.collect_set("ipos")).alias("at"), F.max("size").alias("size")),  # no more than the item has windows
        "window-hits",
    )
    ids = materialize(hits.select("doc_id").distinct(), "hit-docs")
    texts = _texts(docs.join(keys_hint(ids), "doc_id", "left_semi").withColumn("tid", F.xxhash64("text")).dropDuplicates(["doc_id", "tid"]))
    texts = texts.select("doc_id", "tid", F.col("plain").alias("doc_plain"), F.col("words").alias("doc_words"))
    first = F.greatest(F.lit(0), -F.col("shift"))  # first item word that lies inside the document
    length = F.size("plain") - first

    def part_of(name: str, at: Column) -> Column:
        return F.slice(F.col(name), at + 1, F.greatest(length, F.lit(0)))

    pairs = F.arrays_zip(
        part_of("plain", first).alias("a"), part_of("words", first).alias("at"),
        part_of("doc_plain", first + F.col("shift")).alias("b"), part_of("doc_words", first + F.col("shift")).alias("bt"),
    )
    same = F.filter(pairs, lambda p: (p["at"] == p["bt"]) | (p["a"] == p["b"]))
    slots = F.filter(F.col("same"), lambda p: _is_slot(p["at"]) & (p["at"] == p["bt"]))
    distinct = lambda f: F.size(F.array_distinct(F.transform(F.col("slot"), f)))
    steps = F.transform("at", lambda i: F.sequence(i, i + F.col("size") - 1))
    judged = materialize(
        hits.join(items.select("item_id", "plain", "words"), "item_id").join(texts, ["doc_id", "tid"])
        .withColumn("same", same).withColumn("slot", slots)
        .select(
            "doc_id", "tid", "item_id", "shift", F.size("at").cast("long").alias("windows"), F.size("same").alias("same_words"), F.size("plain").alias("item_words"), F.size("slot").alias("slots"),
            ((distinct(lambda p: F.struct(p["a"], p["b"])) == distinct(lambda p: p["a"])) & (distinct(lambda p: p["a"]) == distinct(lambda p: p["b"]))).alias("consistent"),
            F.forall("slot", lambda p: p["a"] == p["b"]).alias("exact"), F.array_distinct(F.flatten(steps)).alias("covered"),
        ), "alignments",
    )
    # Alignments less than NEAR / 2 words apart share a cell of one of two grids; a cell has NEAR alignments of a text and an item at most.
    cells = F.array(F.struct(F.lit(0).alias("grid"), F.floor(F.col("shift") / NEAR).alias("cell")), F.struct(F.lit(1).alias("grid"), F.floor((F.col("shift") + NEAR // 2) / NEAR).alias("cell")))
    joint = (
        judged.where("consistent").withColumn("g", F.explode(cells)).groupBy("doc_id", "tid", "item_id", "g")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("joint")).groupBy("doc_id", "item_id").agg(F.max("joint").alias("joint"))
    )
    good = F.col("consistent") & _enough(F.col("same_words"), F.col("item_words"))
    shown = ["windows", "same_words", "item_words", "slots", "consistent", "exact"]
    best = judged.groupBy("doc_id", "item_id").agg(F.max_by(F.struct(*shown), F.struct(good, "same_words", "consistent", "exact", "slots", "windows")).alias("r"))
    out = best.join(joint, ["doc_id", "item_id"], "left").select("doc_id", "item_id", "r.*", F.coalesce("joint", F.lit(0)).alias("joint_words"))
    out = out.withColumn("contaminated", (F.col("consistent") & _enough(F.col("same_words"), F.col("item_words"))) | _enough(F.col("joint_words"), F.col("item_words")))
    out = out.select("doc_id", "item_id", "windows", "same_words", "joint_words", "item_words", "slots", "consistent", "exact", "contaminated")
    return out if short is None else out.union(short)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents of any contaminated pair."""
    bad = materialize(contaminated_pairs(docs, benchmark).where("contaminated").select("doc_id").distinct(), "contaminated")
    return docs.join(keys_hint(bad), "doc_id", "left_anti").select(*docs.columns)


def _sql_replaced(text: str, pattern: str, new: str) -> str:
    for k in "123":
        new = new.replace("$" + k, chr(92) + k)
    return f"regexp_replace({text}, '{pattern}', '{new}', 'g')"


def oracle() -> str:
    """DuckDB SQL with the contaminated pairs."""
    marked = "text"
    for pattern, new in _MARKING:
        marked = _sql_replaced(marked, pattern, new)
    marked = f"concat('  ', {_sql_replaced(f'lower({marked})', *_STRIP)}, '  ')"
    template = "m"
    for pattern, new in _TYPING:
        template = _sql_replaced(template, pattern, new)
    split = lambda x: f"regexp_split_to_array(trim({x}), '  +')"
    columns = f"{split(_sql_replaced('m', *_PLAIN))} AS plain, {split(template)} AS words"
    enough = lambda n: f"({n} * 2 >= item_words OR {n} >= {ENOUGH})"
    return f"""
WITH im AS (SELECT item_id, {marked} AS m FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT item_id, {columns} FROM im),
it AS (SELECT *, least(len(words), {WINDOW}) AS size FROM i WHERE plain[1] <> ''),
spot AS (SELECT item_id, size, p - 1 AS ipos, words[p : p + size - 1] AS w, plain[p : p + size - 1] AS v
         FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS p FROM it WHERE size >= {LEAST})),
spots AS (SELECT 0 AS kind, item_id, size, ipos, w FROM spot WHERE len(list_filter(w, lambda x: x NOT IN ('n0', 'u0', '0'))) * 2 >= size
          UNION ALL SELECT 1, item_id, size, ipos, v FROM spot),
dm AS (SELECT DISTINCT doc_id, text AS tid, {marked} AS m FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
d AS (SELECT doc_id, tid, {columns} FROM dm),
place AS (SELECT d.*, s.size, unnest(range(1, len(words) - s.size + 2)) AS p FROM d, (SELECT DISTINCT size FROM it WHERE size >= {LEAST}) s),
win AS (SELECT 0 AS kind, doc_id, tid, p - 1 AS pos, words[p : p + size - 1] AS w FROM place
        UNION ALL SELECT 1, doc_id, tid, p - 1, plain[p : p + size - 1] FROM place),
hit AS (SELECT doc_id, tid, item_id, pos - ipos AS shift, list_distinct(list(ipos)) AS places, max(size) AS size FROM win JOIN spots USING (kind, w) GROUP BY ALL),
pair AS (SELECT doc_id, tid, item_id, shift, len(places) AS windows, len(it.plain) AS item_words, len(list_distinct(flatten([range(x, x + hit.size) FOR x IN places]))) AS n_covered, flatten([range(x, x + hit.size) FOR x IN places]) AS covered,
         list_filter([{{'a': it.plain[k], 'ta': it.words[k], 'b': d.plain[k + shift], 'tb': d.words[k + shift]}} FOR k IN range(greatest(0, -shift) + 1, len(it.plain) + 1)],
                     lambda x: x.ta = x.tb OR x.a = x.b) AS same
         FROM hit JOIN it USING (item_id) JOIN d USING (doc_id, tid)),
slot AS (SELECT *, list_filter(same, lambda x: x.ta IN ('n0', 'u0', '0') AND x.ta = x.tb) AS slot FROM pair),
said AS (SELECT doc_id, tid, item_id, shift, windows, len(same) AS same_words, item_words, len(slot) AS slots, covered,
         len(list_distinct([{{'a': x.a, 'b': x.b}} FOR x IN slot])) = len(list_distinct([x.a FOR x IN slot]))
           AND len(list_distinct([x.a FOR x IN slot])) = len(list_distinct([x.b FOR x IN slot])) AS consistent,
         len(list_filter(slot, lambda x: x.a <> x.b)) = 0 AS exact FROM slot),
cell AS (SELECT doc_id, tid, item_id, unnest([{{'g': 0, 'c': floor(shift / {NEAR}.0)}}, {{'g': 1, 'c': floor((shift + {NEAR // 2}) / {NEAR}.0)}}]) AS c, covered FROM said WHERE consistent),
joint AS (SELECT doc_id, item_id, max(n) AS joint_words FROM (SELECT doc_id, tid, item_id, c, len(list_distinct(flatten(list(covered)))) AS n FROM cell GROUP BY ALL) GROUP BY ALL),
best AS (SELECT * FROM said QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY (consistent AND {enough('same_words')}) DESC, same_words DESC, consistent DESC, exact DESC, slots DESC, windows DESC) = 1),
every AS (SELECT doc_id, item_id, windows, same_words, coalesce(joint_words, 0) AS joint_words, item_words, slots, consistent, exact,
          consistent AND {enough('same_words')} OR {enough('coalesce(joint_words, 0)')} AS contaminated FROM best LEFT JOIN joint USING (doc_id, item_id)
          UNION ALL SELECT DISTINCT doc_id, item_id, 1, len(d.plain), len(d.plain), len(d.plain), 0, true, true, true FROM d JOIN it ON it.plain = d.plain AND it.size < {LEAST})
SELECT doc_id, item_id, CAST(windows AS BIGINT) AS windows, CAST(same_words AS INTEGER) AS same_words, CAST(joint_words AS INTEGER) AS joint_words, CAST(item_words AS INTEGER) AS item_words,
       CAST(slots AS INTEGER) AS slots, consistent, exact, contaminated FROM every WHERE contaminated"""
