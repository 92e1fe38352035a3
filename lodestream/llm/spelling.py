r"""Spelling variant grouping (operator 13): near words by dense prefix-suffix tiles.

Words are the maximal runs of ``[A-Za-zÀ-ÿ]`` of whole texts, A-Z
lower-cased; where 31 divides the crc32 of ``<doc_id>:<run>`` the run loses the
code point at that number modulo its length. A null id stands as nothing before
the colon, null texts hold no word, repeated rows count as often as they occur.
Words of at least ``MIN_LENGTH`` code points that occur at least twice make the
vocabulary; everything after that works on distinct words.

Two words are near if one inserted, deleted or replaced code point makes one the
other, that is: the lengths of their common prefix and common suffix add up to
the longer length less one, at least. A tile is a matrix of padded code points,
one row a word; all words of one tile are compared with all words of another at
once: matching columns from the left give the common prefix, from the right the
common suffix.

Which words share a tile follows from the same lengths. Let m be the shorter
word's length, cut into four stretches. An edit leaves either the first half or
the second half alone, and of the other half again the front or the back, so the
two words agree on the key of one of four kinds (:func:`_kinds`); which one is
told by the length of their common prefix alone, so a pair is found once. Rows
are dealt out by key, sorted, and compared within runs of whole keys. Keys of
more than ``HOT`` words are dealt out in blocks of about half of that, one task
row for each pair of blocks of that key. No tile sees words of another key but
those that fill it up, whose pairs it masks.

Each tile adds up, a word, its near words and its best one (largest count, then
code-point order), so what goes on is one row a word and tile. A form occurs at
least ``RATIO`` times as often as its word, so chains of forms end; roots follow
them by pointer doubling. An empty table has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm import textbatch as tb
from lodestream.llm.store import BROADCAST_KEYS, discard, materialize

LETTERS = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, RATIO, DIVISOR = 7, 2, 10, 31
#: Words of a tile, and words of one key from which it is dealt out in blocks.
TILE, HOT = 192, 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all words of ``docs(doc_id, text, ...)``."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_length).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % DIVISOR == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _kinds(m: F.Column | int) -> list[tuple]:
    """(prefix, suffix, least, below) of the four keys of words whose shorter length is ``m``: the lengths of prefix and
    suffix that they share, and the range of common prefixes for which this key is the one that finds them."""
    half = lambda x: (x + 1 - (x + 1) % 2) / 2 if not isinstance(x, int) else (x + 1) // 2  # noqa: E731  rounded up
    a = half(m)
    b = m - a
    c, e = half(b), half(a)
    return [(a + c, 0 * a, a + c, m + 1), (a, b - c, a, a + c), (e, b, e, a), (0 * a, b + a - e, 0 * a, e)]


def keyed(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(key, m, kind, word, n): each word under the keys of its own length and of the length below."""
    m = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m")
    rows = words.select("word", "n", m).where(F.col("m") >= min_length)
    size = F.length("word")
    keys = []
    for k, (prefix, suffix, _, _) in enumerate(_kinds(F.col("m"))):
        prefix, suffix = prefix.cast("int"), suffix.cast("int")
        parts = (F.substring("word", F.lit(1), prefix), F.substring("word", size - suffix + 1, suffix))
        keys.append(F.struct(F.lit(k).alias("kind"), F.xxhash64(F.lit(k), F.col("m"), *parts).alias("key")))
    return rows.select("word", "n", "m", F.explode(F.array(*keys)).alias("k")).select("k.key", "m", "k.kind", "word", "n")


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words padded with 0 at the end, the same padded at the front, and the lengths."""
    lengths = np.array([len(w) for w in words], np.int32)
    width = int(lengths.max(initial=1))
    left = np.zeros((len(words), width), np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    left[np.arange(width) < lengths[:, None]] = flat
    right = np.zeros_like(left)
    right[np.arange(width) >= width - lengths[:, None]] = flat
    return left, right, lengths


def _common(one: np.ndarray, other: np.ndarray, order: range) -> np.ndarray:
    """Length of the agreeing columns in ``order`` of every row of one with every row of the other (padding of both agrees)."""
    going = np.ones((len(one), len(other)), bool)
    out = np.zeros((len(one), len(other)), np.int16)
    for c in order:
        going &= one[:, c, None] == other[None, :, c]
        if not going.any():
            break
        out += going
    return out


def compare(one: tuple, other: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word of one tile is near each of another, and the lengths of their common prefixes."""
    longer = np.maximum(one[2][:, None], other[2][None, :])
    shorter = np.minimum(one[2][:, None], other[2][None, :])
    prefix = np.minimum(_common(one[0], other[0], range(min(one[0].shape[1], other[0].shape[1]))), shorter)
    a, b = one[1], other[1]
    width = min(a.shape[1], b.shape[1])
    suffix = np.minimum(_common(a[:, a.shape[1] - width :], b[:, b.shape[1] - width :], range(width - 1, -1, -1)), shorter)
    same = (longer == shorter) & (prefix == longer)
    return (prefix + suffix >= longer - 1) & ~same, prefix


def _tile(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Near words within the whole keys of ``rows``, in tiles of ``TILE`` words; sums a word and pair of tiles."""
    words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
    key, unit = rows.column("key").to_numpy(), rows.column("unit").to_numpy()
    m, kind, side = rows.column("m").to_numpy(), rows.column("kind").to_numpy(), rows.column("side").to_numpy()
    cuts = range(0, len(words), TILE)
    points = [code_points(words[a : a + TILE]) for a in cuts]
    last = len(words)
    for i, a in enumerate(cuts):
        for j in range(i, len(cuts)):
            b = cuts[j]
            if key[b] != key[min(a + TILE, last) - 1] and j > i:
                break  # sorted by key: no later tile shares one
            u, v = slice(a, min(a + TILE, last)), slice(b, min(b + TILE, last))
            near, prefix = compare(points[i], points[j])
            near &= (key[u, None] == key[None, v]) & (unit[u, None] == unit[None, v])
            if not near.any():
                continue
            bounds = np.array([[k[2:] for k in _kinds(int(x))] for x in m[u]])[np.arange(len(points[i][2])), kind[u]]
            near &= (prefix >= bounds[:, :1]) & (prefix < bounds[:, 1:])
            # Two words of the longer length are a pair of another m; two sides of a block pair are compared across only.
            near &= np.minimum(points[i][2][:, None], points[j][2][None, :]) == m[u, None]
            near &= (side[u, None] != side[None, v]) | (side[u, None] == -1)
            x, y = np.nonzero(near)
            if i == j:
                x, y = x[x < y], y[x < y]
            x, y = np.concatenate([x + a, y + b]), np.concatenate([y + b, x + a])
            if not len(x):
                continue
            best = np.lexsort(([words[q] for q in y], -n[y], x))
            x, y = x[best], y[best]
            first = np.flatnonzero(np.diff(x, prepend=-1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([words[p] for p in x[first]]), pa.array(np.diff(np.append(first, len(x)))),
                    pa.array(n[y[first]]), pa.array([words[q] for q in y[first]]),
                ],
                ["word", "n_near", "best_n", "best"],
            )


def near_counts(words: DataFrame, min_length: int = MIN_LENGTH, hot: int = HOT) -> DataFrame:
    """``words(word, n)``, distinct -> (word, n_near, best, best_n) for every word with a near one."""
    rows = keyed(words, min_length)
    heavy = materialize(rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > hot), "spelling-heavy")
    few = heavy.count()
    if few:
        rows = rows.join(F.broadcast(heavy) if few <= BROADCAST_KEYS // 2 else heavy, "key", "left")
        blocks = F.ceil(F.col("size") * 2 / hot).cast("int")
        own = F.pmod(F.xxhash64("word", F.lit(3)), blocks).cast("int")
        # A block meets each other one across (side 0 against side 1), and itself (side -1).
        pairs = F.transform(
            F.sequence(F.lit(0), blocks - 1),
            lambda o: F.struct(
                (F.least(o, own) * blocks + F.greatest(o, own) + 1).cast("long").alias("unit"),
                F.when(o == own, -1).when(own < o, 0).otherwise(1).alias("side"),
            ),
        )
        single = F.array(F.struct(F.lit(0).cast("long").alias("unit"), F.lit(-1).alias("side")))
        rows = rows.withColumn("p", F.explode(F.when(F.col("size").isNull(), single).otherwise(pairs))).select("key", "m", "kind", "word", "n", "p.unit", "p.side")
    else:
        rows = rows.withColumn("unit", F.lit(0).cast("long")).withColumn("side", F.lit(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 8 * TILE:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key, unit = table.column("key").to_numpy(), table.column("unit").to_numpy()
            ends = np.flatnonzero((key[1:] != key[:-1]) | (unit[1:] != unit[:-1])) + 1
            whole = int(ends[-1]) if len(ends) else 0  # the last key may go on
            if whole:
                yield from _tile(table.slice(0, whole).combine_chunks())
            held = table.slice(whole).to_batches()
        if held:
            yield from _tile(pa.Table.from_batches(held).combine_chunks())

    dealt = rows.repartition("key", "unit").sortWithinPartitions("key", "unit", "m", "kind", "word")
    tiles = dealt.mapInArrow(tb.task(run), "word string, n_near long, best_n long, best string")
    better = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return tiles.groupBy("word").agg(F.sum("n_near").alias("n_near"), better.alias("b")).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(links: DataFrame) -> DataFrame:
    """``links(word, form)``, one form a word and no cycles -> (word, root): the end of each word's chain, by pointer doubling."""
    now = materialize(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        moved = after.where("moved").limit(1).count()
        discard(now)
        now = after.select("word", "root")
        if not moved:
            return now


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, hot: int = HOT) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> (word, form, root, n, n_near, form_n), one row per distinct word."""
    words = materialize(vocabulary(docs, min_length, min_count), "spelling-words")
    near = materialize(near_counts(words, min_length, hot), "spelling-near")
    forms = words.join(near, "word", "left").withColumn("takes", F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False)))
    rows = materialize(
        forms.select("word", F.when(F.col("takes"), F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("takes"), F.col("best_n")).alias("form_n")),
        "spelling-forms",
    )
    ends = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle() -> str:
    """DuckDB SQL for the same rows; crc32 is folded over the bytes with a table made by the polynomial's rule."""
    return f"""
WITH RECURSIVE steps AS (
  SELECT i AS byte, i::UBIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY byte) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '{LETTERS}')) AS run FROM documents
), lowered AS (
  SELECT id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS n FROM runs WHERE length(run) >= {MIN_LENGTH} GROUP BY 1, 2
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, octet_length(encode(id || ':' || run))::BIGINT), lambda i: ('0x' || substr(hex(encode(id || ':' || run)), (2 * i + 1)::BIGINT, 2))::UBIGINT)),
    lambda a, b: xor(a // 256, t[(xor(a % 256, b) + 1)::BIGINT])), 4294967295::UBIGINT) AS h
  FROM lowered, crc
), cut AS (
  SELECT CASE WHEN h % {DIVISOR} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= {MIN_LENGTH} GROUP BY 1 HAVING sum(n) >= {MIN_COUNT}
), gaps AS (
  SELECT word, substr(word, 1, i) || chr(1) || substr(word, i + 2) AS gap FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
  UNION ALL
  SELECT word, substr(word, 1, i) || chr(1) || substr(word, i + 1) FROM (SELECT word, unnest(range(length(word) + 1)) AS i FROM words)
), near AS (
  SELECT DISTINCT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.gap = b.gap AND a.word <> b.word
), best AS (
  SELECT w.word, w.n, count(o.word) AS n_near, first(o.word ORDER BY o.n DESC, o.word) AS other, max(o.n) AS other_n
  FROM words w LEFT JOIN near USING (word) LEFT JOIN words o ON o.word = near.other GROUP BY 1, 2
), forms AS (
  SELECT word, CASE WHEN other_n >= {RATIO} * n THEN other END AS form, n, n_near, CASE WHEN other_n >= {RATIO} * n THEN other_n END AS form_n FROM best
), chain AS (
  SELECT word, word AS at, form FROM forms
  UNION ALL
  SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.form
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""
