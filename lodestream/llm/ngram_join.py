"""N-gram Jaccard join (operator 7): grouped prefix join on word shingles, exact.

Two texts link when the Jaccard similarity of their shingle sets is at least
``num / den``. The plan:

1. *Classes.* Each text becomes a sorted set of shingle hashes, of which only the
   size and two signatures are kept; equal sets form one class, for which one
   document stands from then on.
2. *Heavy shingles.* Each task counts the shingles of its own texts; those seen
   more than once in a piece are summed over the corpus. The heaviest go to the
   end of the global order, so common passages leave the prefixes. The order is
   only a matter of speed: any order gives the same links. Sets of equal prefix
   (about a fifth of the set) and size form one group; one of it posts the prefix.
3. *Stars.* In each posting list every group meets the best hub (the one with
   the smallest share of light shingles): linear in the list. Heavy lists are
   salted; there every group meets the hub of its salt and the best of all salts.
4. *Filter, expand, verify.* From the number of prefix shingles that a pair of
   groups shares follows an upper bound of the overlap; pairs above it expand to
   members. A parity bitmap of each member's set (one to two bits a shingle) bounds
   the difference of two sets from below; pairs that pass are intersected exactly.
5. *The rest.* Links found so far give components. Only lists (and groups) that
   still hold several components are joined with themselves, and only across
   components: links inside one cannot change the result. A pair is written only
   where a run of shared shingles begins (the shingle before it differs), and only
   if what follows that place in both sets can reach the threshold: at the first
   shared shingle this is the positional bound, and later places allow less. In
   heavy lists a bound from each posting's own counts keeps apart what heavy
   shingles alone cannot link; pairs that share a light shingle meet in its
   (short) list.

Rows with a null id keep their shingle count and get no component. Rows that
repeat an id count as one document with several texts. Null, empty and
blank-only texts have no shingles and link with nothing; their component is
their own id. No text is cut, and no list or group is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm import textbatch as tb
from lodestream.llm.components import components
from lodestream.llm.store import BROADCAST_KEYS, bounded_batches, discard, keys_hint, materialize

#: Shingles in at least this many texts may count as heavy.
HEAVY_FROM = 8
#: The heavy list has at most this many entries of 8 bytes; its lowest count rises until that holds.
HEAVY_MOST = 500_000
#: Salts for the posting list of a heavy shingle.
SALTS = 64
#: Partners of a hub that one task verifies.
PARTNERS = 256
_HEAVY_BIT = 1 << 62
_SHARE = (1 << 8) - 1


def _keys(batch: pa.RecordBatch, heavy: np.ndarray, size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Per piece of a batch the sorted shingle keys of each text; heavy keys come last."""
    for rows, data, offsets in tb.pieces(batch, "text"):
        starts, ends, first = tb.words(data, offsets)
        hashes = tb.hash_words(data, starts, ends)
        sets = []
        for part in tb.shingles(hashes, first, size):
            keys = np.unique((part >> np.uint64(2)).astype(np.int64))
            if len(heavy) and len(keys):
                at = np.searchsorted(heavy, keys)
                known = heavy[np.minimum(at, len(heavy) - 1)] == keys
                if known.any():
                    keys = np.concatenate([keys[~known], keys[known] | _HEAVY_BIT])
            sets.append(keys)
        yield rows, sets


def _heavy_counts(size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _keys(batch, np.zeros(0, np.int64), size):
                keys, n = np.unique(np.concatenate(sets or [np.zeros(0, np.int64)]), return_counts=True)
                often = n > 1
                yield pa.RecordBatch.from_arrays([pa.array(keys[often]), pa.array(n[often])], ["k", "n"])

    return count


def heavy_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted keys of the heaviest shingles, ``HEAVY_MOST`` at most."""
    counts = materialize(
        docs.select("text").mapInArrow(tb.task(_heavy_counts(size)), "k long, n long")
        .groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY_FROM),
        "shingle-counts",
    )
    steps = counts.groupBy(F.floor(F.log2("n")).alias("e")).count().orderBy(F.desc("e")).collect()
    total, lowest = 0, None
    for step in steps:
        total += step["count"]
        if total > HEAVY_MOST:
            break
        lowest = 2 ** step["e"]
    heavy = counts.where(F.col("n") >= lowest).select("k").toPandas()["k"].to_numpy() if lowest else np.zeros(0, np.int64)
    discard(counts)
    return np.sort(heavy)


def _signature(keys: np.ndarray) -> tuple[int, int]:
    wide = keys.view(np.uint64)
    with np.errstate(over="ignore"):
        return int(tb.mix(wide).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(tb.mix(wide + np.uint64(0x5851F42D4C957F2D)), initial=np.uint64(0)).view(np.int64))


def _signatures(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, sets in _keys(batch, np.zeros(0, np.int64), size):
                signed = [(len(keys), *_signature(keys)) for keys in sets]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), *[pa.array([x[k] for x in signed], pa.int64()) for k in range(3)]], ["doc_id", "n", "set_a", "set_b"]
                )

    return sign


def _parities(keys: np.ndarray) -> bytes:
    """Per bit the parity of the number of keys that fall on it; as many bits as the next power of two from the number of keys on, 64 at least."""
    size = 1 << max(6, (len(keys) - 1).bit_length())
    return np.packbits((np.bincount(keys & (size - 1), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def _apart(a: np.ndarray, b: np.ndarray) -> int:
    """A number of keys by which two sets differ at least, from their parities as 64-bit numbers."""
    while len(a) != len(b):  # the longer one folds to half its bits
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _prefixes(heavy: np.ndarray, size: int, num: int, den: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, sets in _keys(batch, heavy, size):
                parts = [keys[: len(keys) - (num * len(keys) + den - 1) // den + 1] if len(keys) else keys for keys in sets]
                columns = [
                    [len(k) for k in sets], [_signature(p)[0] for p in parts], [int(np.searchsorted(k, _HEAVY_BIT)) for k in sets],
                    [int(p[-1]) if len(p) else None for p in parts],
                ]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns], pa.array([_parities(k) for k in sets], pa.binary()), pa.array([p.tobytes() for p in parts], pa.binary())],
                    ["doc_id", "n", "psig", "light", "last", "bits", "prefix"],
                )

    return cut


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prefixes = [np.frombuffer(p, np.int64) for p in batch.column("prefix").to_pylist()]
        if not prefixes:
            continue
        many = np.array([len(p) for p in prefixes])
        keys = np.concatenate(prefixes)
        ids = np.repeat(batch.column("doc_id").to_numpy(), many)
        salt = np.where(keys >= _HEAVY_BIT, tb.mix(ids.view(np.uint64)) % np.uint64(SALTS), np.uint64(0)).astype(np.int32)
        n, light = (np.repeat(batch.column(c).to_numpy(), many) for c in ("n", "light"))
        place = np.arange(len(keys)) - np.repeat(np.cumsum(many) - many, many)
        # The size, the share of heavy shingles rounded up and the place in the set rounded down, in one number.
        columns = [keys, salt, ids, (n << 16) | (-(-(n - light) * _SHARE // n) << 8) | (place * _SHARE // n)]
        step = 100_000
        for at in range(0, len(keys), step):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + step]) for c in columns], ["k", "salt", "g", "at"])


def _whole_sets(heavy: np.ndarray, size: int):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, sets in _keys(batch, heavy, size):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["node", "keys"])

    return whole


def _near(num: int, den: int):
    """Rows (node, n, bits, hub, part, role) sorted by hub, its own first: the partners that its bitmap does not keep apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in batches:
            u, v = [], []
            for hub, part, role, node, n, bits in zip(*[batch.column(c).to_pylist() for c in ("hub", "part", "role", "node", "n", "bits")], strict=True):
                if (hub, part) != at:
                    at, own = (hub, part), []
                mine = np.frombuffer(bits, np.uint64)
                if role == 0:
                    own.append((n, mine))
                elif any((n + m - _apart(mine, x)) * (num + den) >= 2 * num * (n + m) for m, x in own if m * den >= n * num and n * den >= m * num):
                    u.append(min(hub, node))
                    v.append(max(hub, node))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _passing(num: int, den: int):
    """Rows sorted by hub, its own set first: the partners that link with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in batches:
            keys = batch.column("keys")
            edges, flat = keys.offsets.to_numpy(), keys.values.to_numpy()
            u, v = [], []
            for k, (hub, part, role, node) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("hub", "part", "role", "node")], strict=True)):
                if (hub, part) != at:
                    at, own = (hub, part), []
                mine = flat[edges[k] : edges[k + 1]]
                if role == 0:  # an id with several texts has several sets
                    own.append(mine)
                elif any((both := len(np.intersect1d(mine, x, assume_unique=True))) and both * den >= num * (len(mine) + len(x) - both) for x in own):
                    u.append(min(hub, node))
                    v.append(max(hub, node))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _entry():
    """A posting's set as a struct whose order puts hubs first: sets with the smallest share of light shingles.

    ``heavy`` is at least the number of heavy shingles.
    """
    n, share = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(F.lit(_SHARE))
    return F.struct((-share).alias("hub"), n.alias("n"), "g", F.ceil(share * n / F.lit(_SHARE)).alias("heavy"))


def _follow():
    """At least the number of shingles of a posting's set from this one on."""
    n = F.shiftright("at", 16)
    return n - F.floor(F.col("at").bitwiseAND(F.lit(_SHARE)) * n / F.lit(_SHARE))


def _enough(overlap, a, b, num: int, den: int):
    """Whether an overlap reaches the threshold for two sets of known sizes."""
    return overlap * (num + den) >= num * (a["n"] + b["n"])


def _heavy_can_do(a, b, num: int, den: int):
    """Whether two sets could link through heavy shingles alone: a bound from each posting by itself."""
    return _enough(F.least(a["heavy"], b["heavy"]), a, b, num, den)


def _may_link(pairs: DataFrame, lasts: DataFrame, num: int, den: int) -> DataFrame:
    """Group pairs (a, b as entries; ``shared_light`` and ``shared_heavy`` prefix keys) whose overlap can reach the threshold.

    The prefix that ends first holds every key that both sets share up to its
    last key, so the overlap is at most the shared ones plus the rest of that
    set. Where both prefixes reach into the heavy keys, all light keys are in
    them, and the overlap is at most the shared light keys plus the heavy keys
    of either set; if no light key is shared, the first bound holds with the
    shared heavy keys. A pair that shares light keys needs no count of heavy ones.
    """
    a, b = F.col("a"), F.col("b")
    rest = lambda s: s["n"] - (s["n"] - F.ceil(s["n"] * num / F.lit(den)).cast("long") + 1)
    # What neither order of the prefix ends allows goes before they are looked up.
    most = F.greatest(rest(a), rest(b))
    heavies = F.least(a["heavy"], b["heavy"])
    loose = F.when(F.col("shared_light") > 0, F.col("shared_light") + F.greatest(most, heavies)).otherwise(F.least(F.greatest(heavies, most), F.col("shared_heavy") + most))
    pairs = pairs.where(_enough(loose, a, b, num, den))
    pairs = pairs.join(lasts.select(F.col("g").alias("ga"), F.col("last").alias("la")), a["g"] == F.col("ga"))
    pairs = pairs.join(lasts.select(F.col("g").alias("gb"), F.col("last").alias("lb")), b["g"] == F.col("gb"))
    first_rest = F.when(F.col("la") <= F.col("lb"), rest(a)).otherwise(rest(b))
    ends_light = F.least("la", "lb") < _HEAVY_BIT
    by_light = F.when(ends_light, F.col("shared_light") + first_rest).otherwise(
        F.col("shared_light") + heavies
    )
    by_heavy = F.least(by_light, F.col("shared_heavy") + first_rest)
    bound = F.when(F.col("shared_light") > 0, by_light).otherwise(by_heavy)
    return pairs.where(_enough(bound, a, b, num, den)).select(a["g"].alias("g1"), b["g"].alias("g2"))


def _counted(rows: DataFrame) -> DataFrame:
    heavy = F.col("k") >= _HEAVY_BIT
    return rows.groupBy("a", "b").agg(F.count_if(~heavy).alias("shared_light"), F.count_if(heavy).alias("shared_heavy"))


def _sizes_fit(a, b, num: int, den: int):
    return (a["n"] * den >= b["n"] * num) & (b["n"] * den >= a["n"] * num)


def ngram_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> (doc_id, n_shingles, component_id), one row per input row.

    ``size`` words a shingle (8 at most); texts link from similarity ``num / den`` on.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    bounded_batches(docs.sparkSession)
    signed = materialize(docs.mapInArrow(tb.task(_signatures(size)), "doc_id long, n long, set_a long, set_b long"), "shingle-signatures")
    usable = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = materialize(usable.groupBy("n", "set_a", "set_b").agg(F.min("doc_id").alias("cid")), "shingle-classes")
    doc_class = materialize(
        signed.join(classes, ["n", "set_a", "set_b"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("cid")).alias("cid")), "doc-classes"
    )
    discard(signed)
    discard(classes)
    copies = materialize(
        doc_class.where("cid IS NOT NULL").groupBy("doc_id").agg(F.count_if(F.col("cid") == F.col("doc_id")).alias("own")).where("own = 0").select("doc_id"), "shingle-copies"
    )
    # From here on one document stands for each set.
    firsts = docs.where("doc_id IS NOT NULL").join(keys_hint(copies), "doc_id", "left_anti")
    heavy = heavy_shingles(firsts, size)
    table = materialize(
        firsts.mapInArrow(
            tb.task(_prefixes(heavy, size, num, den)), "doc_id long, n long, psig long, light long, last long, bits binary, prefix binary"
        ).where("n > 0"), "shingle-prefixes",
    )
    bitmaps = materialize(table.select(F.col("doc_id").alias("node"), "n", "bits"), "shingle-bitmaps")
    narrow = table.select("doc_id", "n", "psig")
    groups = materialize(narrow.groupBy("n", "psig").agg(F.min("doc_id").alias("g"), F.count("*").alias("m")), "shingle-groups")
    #: Documents whose group has another representative.
    inner = materialize(
        narrow.join(groups.where("m > 1").select("n", "psig", "g"), ["n", "psig"]).where("doc_id <> g")
        .select(F.col("doc_id").alias("cid"), "g", "psig").distinct(), "shingle-members",
    )
    lasts = materialize(groups.select("g", "n", "psig").join(table.select(F.col("doc_id").alias("g"), "n", "psig", "last"), ["g", "n", "psig"]).select("g", "last").distinct(), "shingle-lasts")
    silent = inner.select(F.col("cid").alias("doc_id"), "psig")
    postings = (
        table.join(F.broadcast(silent) if silent.count() <= BROADCAST_KEYS // 2 else silent, ["doc_id", "psig"], "left_anti")
        .select("doc_id", "n", "light", "prefix")
        .mapInArrow(tb.task(_postings), "k long, salt int, g long, at long")
    )
    by_list = Window.partitionBy("k", "salt").orderBy(_entry())
    shared_lists = materialize(
        postings.select("k", "salt", "g", "at", F.first(_entry()).over(by_list).alias("top"),
                        F.lead("g").over(by_list).alias("next"))
        .where(f"top.g <> g OR next IS NOT NULL OR k >= {_HEAVY_BIT}").drop("next"),
        "shingle-lists",
    )
    discard(table)
    discard(copies)

    def at_hubs(pairs: DataFrame, rows: DataFrame, test, name: str) -> DataFrame:
        """Of class pairs (u, v) those that pass ``test``, which gets ``rows(node, ...)`` sorted by hub.

        The side with more partners is the pair's hub. Each row goes once to each of its hubs, and a hub's row to
        as many tasks as its partners need; there the partners pass by one after another.
        """
        ends = pairs.select("u").union(pairs.select("v")).toDF("node")
        degree = materialize(ends.groupBy("node").agg(F.count("*").alias("d")), "degrees")
        side = lambda x: degree.select(F.col("node").alias(x), F.col("d").alias(f"d{x}"))
        hub = F.col("du") >= F.col("dv")
        placed = materialize(
            pairs.join(side("u"), "u").join(side("v"), "v").select(
                F.when(hub, F.col("u")).otherwise(F.col("v")).alias("hub"), F.when(hub, F.col("v")).otherwise(F.col("u")).alias("node"),
                F.ceil(F.greatest("du", "dv") / F.lit(PARTNERS)).cast("int").alias("m"),
            ).withColumn("part", F.pmod(F.xxhash64("node"), F.col("m")).cast("int")), "placed-pairs",
        )
        spots = placed.select("node", "hub", "part", F.lit(1).alias("role")).union(
            placed.select(F.col("hub").alias("node"), "hub", "part", F.lit(0).alias("role")).distinct()
        )
        spots = materialize(spots, "set-places")
        few = spots.count() <= BROADCAST_KEYS // 4  # four columns a row
        nodes = degree.select("node")
        found = materialize(
            rows.join(F.broadcast(nodes) if few else nodes, "node", "left_semi").join(F.broadcast(spots) if few else spots, "node")
            .repartition("hub", "part").sortWithinPartitions("hub", "part", "role", "node")
            .mapInArrow(tb.task(test), "u long, v long").distinct(),
            name,
        )
        for old in (degree, placed, spots):
            discard(old)
        return found

    def verified(pairs: DataFrame) -> DataFrame:
        """Of class pairs (u, v) those that link: by their bitmaps first, then by their sets."""
        pairs = materialize(pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
        near = at_hubs(pairs, bitmaps, _near(num, den), "near-pairs")
        ends = materialize(near.select(F.col("u").alias("doc_id")).union(near.select("v")).distinct(), "near-docs")
        sets = docs.join(keys_hint(ends), "doc_id", "left_semi").mapInArrow(tb.task(_whole_sets(heavy, size)), "node long, keys array<long>")
        found = at_hubs(near, sets, _passing(num, den), "links")
        for old in (pairs, near, ends):
            discard(old)
        return found

    # Links by stars: each list's groups with its best hub.
    heavy_rows = shared_lists.where(f"k >= {_HEAVY_BIT}")
    tops = materialize(heavy_rows.where("g = top.g").groupBy("k").agg(F.min("top").alias("a")), "list-hubs")  # HEAVY_MOST rows at most
    candidates = (
        shared_lists.select("k", F.col("top").alias("a"), _entry().alias("b"))
        .union(heavy_rows.join(F.broadcast(tops), "k").where("top.g <> a.g").select("k", "a", _entry().alias("b")))
    )
    a, b = F.col("a"), F.col("b")
    heavy_fits = (F.col("k") < _HEAVY_BIT) | _heavy_can_do(a, b, num, den)
    stars = _may_link(_counted(candidates.where((a["g"] != b["g"]) & _sizes_fit(a, b, num, den) & heavy_fits)), lasts, num, den).toDF("u", "v")
    links = verified(stars.union(inner.select(F.col("g").alias("u"), F.col("cid").alias("v"))))

    # The rest: lists and groups that still hold several components.
    known = materialize(components(links), "components")
    as_class = (
        groups.select("g", F.col("g").alias("cid")).union(inner.select("g", "cid")).distinct()
        .join(known.withColumnRenamed("node", "cid"), "cid", "left")
        .select("g", "cid", F.coalesce("component", "cid").alias("comp"))
    )
    member = materialize(as_class, "members")
    texts = groups.groupBy("g").agg(F.count("*").cast("int").alias("texts")).where("texts > 1")
    span = member.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).join(texts, "g", "left").withColumn("texts", F.coalesce("texts", F.lit(1)))
    # Groups of one class that no link has reached stand for themselves; only the others are looked up.
    moved = materialize(span.where("lo <> g OR hi <> g OR texts > 1"), "moved-groups")
    known_span = F.broadcast(moved) if moved.count() <= BROADCAST_KEYS // 2 else moved
    listed = shared_lists.select("k", "g", "at").join(known_span, "g", "left")
    listed = listed.withColumn("lo", F.coalesce("lo", "g")).withColumn("hi", F.coalesce("hi", "g")).withColumn("texts", F.coalesce("texts", F.lit(1)))
    open_lists = materialize(
        listed.groupBy("k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("c")).where("lo < hi AND c > 1").select("k"),
        "open-lists",
    )
    # The open key before each in the same set; unknown where an id has several sets.
    before = F.when(F.col("texts") == 1, F.lag("k").over(Window.partitionBy("g").orderBy("k")))
    open_rows = materialize(listed.join(keys_hint(open_lists), "k").withColumn("prev", before).drop("texts"), "open-rows")
    side = lambda x: open_rows.select("k", _entry().alias(x), _follow().alias(f"follow_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("prev", "lo", "hi")])
    across = (
        side("a").join(side("b"), "k")
        .where(((a["n"] < b["n"]) | ((a["n"] == b["n"]) & (a["g"] < b["g"]))) & _sizes_fit(a, b, num, den))
        .where("NOT (lo_a = hi_a AND lo_b = hi_b AND lo_a = lo_b)").where(heavy_fits)
        .where("prev_a IS NULL OR prev_b IS NULL OR prev_a <> prev_b").where(_enough(F.least("follow_a", "follow_b"), a, b, num, den))
    )
    of = lambda g, c: member.select(F.col("g").alias(g), F.col("cid").alias(c), F.col("comp").alias(f"comp_{c}"))
    group_pairs = across.select(a["g"].alias("g1"), b["g"].alias("g2")).distinct().union(
        span.where("lo < hi").select(F.col("g").alias("g1"), F.col("g").alias("g2"))
    )
    rest = (
        group_pairs.join(of("g1", "u"), "g1").join(of("g2", "v"), "g2").where("comp_u <> comp_v")
        .select("u", "v").join(links.select("u", "v"), ["u", "v"], "left_anti")
    )
    more = verified(rest)

    # An id with several texts is one document.
    same_id = (
        doc_class.where("cid IS NOT NULL").groupBy("doc_id").agg(F.min("cid").alias("u"), F.max("cid").alias("w"), F.collect_set("cid").alias("all"))
        .where("u <> w").select("u", F.explode("all").alias("v"))
    )
    final = materialize(components(links.union(more).union(same_id)), "components")
    for old in (tops, bitmaps, groups, inner, lasts, shared_lists, links, known, member, moved, open_lists, open_rows, more):
        discard(old)
    return (
        doc_class.join(final, F.col("cid") == F.col("node"), "left")
        .select("doc_id", F.col("n").alias("n_shingles"),
                F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "cid", "doc_id")).alias("component_id"))
    )
