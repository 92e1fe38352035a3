"""Embedding near-duplicates (operator 6): NN-descent on cosine, threshold links, exact counts inside components.

Equal unit vectors are one weighted vector until the end, so copies do not fill lists.

1. *Start.* Random hyperplanes give each vector a few sort orders; neighbours in
   an order are first candidates.
2. *Descent.* Each round every vector brings its best neighbours, and some that
   have it as a neighbour, together: a task holds the vectors that meet at one
   vector and proposes the pairs better than either side's worst neighbour.
   Lists keep the best ``k``.
3. *Audit.* Query vectors are compared with all vectors, in blocks. More are drawn,
   outside the groups seen so far, until ``LINKED`` of small groups have links or a
   bound is reached. Recall is each query's share of links that the components
   found hold, by size of its group; the worst size counts. Below ``RECALL``, new
   sort orders, lists twice as long and another round follow, and after four
   attempts more orders while it is below ``FLOOR``; then the run fails. Without any
   link to judge by, recall is null, or 1 if no vector was left to draw. Links that
   the audit finds are kept.
4. *Saturated lists.* A vector whose whole list passes the threshold may have
   more links than its list holds. A link that neither side's list holds joins two
   such vectors. So those of different components are compared exactly, in blocks;
   pairs of blocks whose centres and radii rule a link out (triangle inequality of
   angles) are left out. What links joins components, before recall is measured.
5. *Counts.* Components are cut into blocks, pairs of blocks are multiplied, and
   each vector's links are counted exactly. No pair is written.

Null, zero and non-finite vectors, and vectors of another length than most, link
with nothing. Null ids are left out of links and are their own rows with null
component. Rows that repeat an id with equal vectors are one vector; an id with
several vectors has the links of each of them (``n_links`` is their sum). Cosines
are computed in double precision from the given components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.components import components
from lodestream.llm.store import BROADCAST_KEYS, discard, materialize

TABLES, BITS, REACH = 16, 14, 6
NEIGHBOURS, ROUNDS, RECALL = 10, 3, 0.97
FLOOR, ATTEMPTS, LINKED, DRAWS = 0.9, 16, 64, 16
BLOCK = 1024
_EDGE = "a long, b long, cos double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a non-empty column of equal-length lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _vectors(table: DataFrame) -> DataFrame:
    """(id, v) of unit vectors in double precision; the most common length only."""
    v = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL").where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (top["n"] if top else 0))
    largest = F.array_max(F.transform("v", F.abs))  # scaled first, so that squares neither overflow nor vanish
    rows = rows.where(largest > 0).withColumn("v", F.transform("v", lambda x: x / largest))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("v", F.transform("v", lambda x: x / norm)).distinct()


def _bits(n: int) -> int:
    """Hyperplanes of an order: about three of ``n`` vectors a key, whatever their number."""
    return max(BITS, round(np.log2(max(n, 3) / 3)))


def _orders(width: int, tables: int, seed: int, bits: int = BITS):
    """Rows of each sort order: (table, key, id, v)."""
    planes = np.random.default_rng(seed).normal(size=(tables, bits, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"))
                for t in range(tables):
                    side = x @ planes[t].T > 0
                    gray = np.bitwise_xor.accumulate(side, axis=1)  # neighbours in the order differ in one side
                    key = gray @ (1 << np.arange(bits)[::-1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(key), batch.column("id"), batch.column("v")], ["t", "key", "id", "v"])

    return run


def _adjacent(reach: int, k: int):
    """Of vectors in sorted order the pairs at most ``reach`` apart; per batch each vector's best ``k``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column("id").to_numpy(), _matrix(batch.column("v"))
            if carry is not None:
                ids, x = np.concatenate([carry[0], ids]), np.concatenate([carry[1], x])
            a, b, c = [], [], []
            for d in range(1, min(reach, len(ids) - 1) + 1):
                a.append(ids[:-d])
                b.append(ids[d:])
                c.append(np.einsum("ij,ij->i", x[:-d], x[d:]))
            carry = ids[-reach:], x[-reach:]
            if a:
                yield _best(np.concatenate(a), np.concatenate(b), np.concatenate(c), k)

    return run


def _best(a: np.ndarray, b: np.ndarray, c: np.ndarray, k: int) -> pa.RecordBatch:
    """Both directions of the pairs, each once, each vector's best ``k``."""
    keep = a != b
    a, b, c = np.concatenate([a[keep], b[keep]]), np.concatenate([b[keep], a[keep]]), np.concatenate([c[keep], c[keep]])
    order = np.lexsort((-c, b, a))
    a, b, c = a[order], b[order], c[order]
    new = (np.diff(a, prepend=a[:1] - 1) != 0) | (np.diff(b, prepend=b[:1] - 1) != 0)
    a, b, c = a[new], b[new], c[new]
    order = np.lexsort((b, -c, a))
    a, b, c = a[order], b[order], c[order]
    begin = np.flatnonzero(np.diff(a, prepend=a[:1] - 1)) if len(a) else np.zeros(0, int)
    rank = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a))))
    top = rank < k
    return pa.RecordBatch.from_arrays([pa.array(a[top]), pa.array(b[top]), pa.array(c[top])], ["a", "b", "cos"])


def _top(edges: DataFrame, k: int) -> DataFrame:
    """Each vector's best ``k`` distinct neighbours; Spark limits within tasks before it shuffles."""
    w = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    return edges.groupBy("a", "b").agg(F.max("cos").alias("cos")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``at``: pairs of vectors that meet there and improve on either side's worst neighbour."""
    rest: pa.Table | None = None

    def pairs(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        at, ids, worst = (t.column(c).to_numpy() for c in ("at", "id", "worst"))
        x = _matrix(t.column("v").chunk(0)) if t.num_rows else np.zeros((0, 1))
        edges = np.append(np.flatnonzero(np.diff(at, prepend=at[:1] - 1)), len(at))
        a, b, c = [], [], []
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if e - s < 2:
                continue
            g = x[s:e] @ x[s:e].T
            i, j = np.nonzero(np.triu(g > np.minimum(worst[s:e, None], worst[None, s:e]), 1))
            a.append(ids[s + i])
            b.append(ids[s + j])
            c.append(g[i, j])
        none = np.zeros(0, np.int64)
        return _best(np.concatenate(a or [none]), np.concatenate(b or [none]), np.concatenate(c or [none.astype(float)]), 1 << 30)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        at = t.column("at").to_numpy()
        cut = int(np.searchsorted(at, at[-1])) if len(at) else 0
        if cut:
            yield pairs(t.slice(0, cut))
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield pairs(rest)


def _descend(graph: DataFrame, vectors: DataFrame, k: int, sample: int) -> DataFrame:
    """One round: (a, b, cos) proposals from neighbours of neighbours."""
    near = graph.where(F.col("rank") <= sample).select("a", "b")
    w = Window.partitionBy("b").orderBy(F.xxhash64("a", "b"), "a")
    back = near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= sample).select(F.col("b").alias("a"), F.col("a").alias("b"))
    worst = graph.groupBy("a").agg(F.when(F.count("*") >= k, F.min("cos")).otherwise(F.lit(-1.0)).alias("worst"))
    meet = near.union(back).distinct().toDF("at", "id").join(vectors, "id").join(worst.withColumnRenamed("a", "id"), "id", "left")
    return (
        meet.select("at", "id", F.coalesce("worst", F.lit(-1.0)).alias("worst"), "v")
        .repartition("at").sortWithinPartitions("at").mapInArrow(_meet, _EDGE)
    )


def _links_of(queries: tuple[np.ndarray, np.ndarray], threshold: float):
    """Links of a bounded set of query vectors with each task's vectors."""
    qid, q = queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(at, BLOCK)
                ids = rows.column("id").to_numpy()
                g = q @ _matrix(rows.column("v")).T
                i, j = np.nonzero(g >= threshold)
                keep = qid[i] != ids[j]
                yield pa.RecordBatch.from_arrays([pa.array(qid[i][keep]), pa.array(ids[j][keep]), pa.array(g[i, j][keep])], ["a", "b", "cos"])

    return run


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's centre and the largest angle to it."""
    for batch in batches:
        for k in range(batch.num_rows):
            x = _matrix(batch.column("rows").slice(k, 1).flatten().field("v"))
            mean = x.mean(0)
            norm = np.linalg.norm(mean)
            centre = mean / norm if norm > 1e-9 else x[0]
            radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
            yield pa.RecordBatch.from_arrays([batch.column("component").slice(k, 1), batch.column("i").slice(k, 1), pa.array([centre.tolist()]), pa.array([radius])], ["component", "i", "centre", "radius"])


def _near_balls(threshold: float):
    """Rows of two groups of balls: pairs of blocks of different components that can hold a link."""
    widest = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one, two = (batch.column(c).slice(k, 1).flatten() for c in ("one", "two"))
                (c1, i1, r1), (c2, i2, r2) = ([side.field(f).to_numpy() for f in ("component", "i", "radius")] for side in (one, two))
                angle = np.arccos(np.clip(_matrix(one.field("centre")) @ _matrix(two.field("centre")).T, -1, 1))
                hit = (angle <= r1[:, None] + r2[None] + widest) & (c1[:, None] != c2[None])
                if batch.column("p")[k].as_py() == batch.column("q")[k].as_py():
                    hit = np.triu(hit)
                a, b = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays([pa.array(c1[a]), pa.array(i1[a]), pa.array(c2[b]), pa.array(i2[b])], ["c1", "i1", "c2", "i2"])

    return run


def _best_pair(threshold: float):
    """Rows of two blocks of different components: their best pair, if it is a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for k in range(batch.num_rows):
                one, two = (batch.column(c).slice(k, 1).flatten() for c in ("one", "two"))
                g = _matrix(one.field("v")) @ _matrix(two.field("v")).T
                i, j = np.unravel_index(int(g.argmax()), g.shape)
                if g[i, j] >= threshold:
                    u.append(one.field("id")[int(i)].as_py())
                    v.append(two.field("id")[int(j)].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _saturated_links(graph: DataFrame, member: DataFrame, vectors: DataFrame, threshold: float, k: int) -> DataFrame:
    """(u, v): a link of every two blocks of different components that are linked, over vectors whose full list passes ``threshold``."""
    lists = graph.groupBy("a").agg(F.count("*").alias("n"), F.min("cos").alias("worst"))
    full = lists.where((F.col("n") >= k) & (F.col("worst") >= threshold)).select(F.col("a").alias("node"))
    blocks = materialize(_blocks(member.join(full, "node"), vectors), "full-blocks")
    balls = materialize(blocks.select("component", "i", "rows").mapInArrow(_balls, "component long, i int, centre array<double>, radius double"), "balls")
    groups = balls.count() // BLOCK + 1
    dealt = balls.withColumn("p", F.pmod(F.xxhash64("component", "i"), F.lit(groups))).groupBy("p")
    dealt = materialize(dealt.agg(F.collect_list(F.struct("component", "i", "centre", "radius")).alias("one")), "ball-groups")
    both = dealt.crossJoin(dealt.toDF("q", "two")).where("p <= q")
    near = materialize(both.mapInArrow(_near_balls(threshold), "c1 long, i1 int, c2 long, i2 int"), "near-blocks")
    rows = blocks.select("component", "i", "rows")
    return near.join(rows.toDF("c1", "i1", "one"), ["c1", "i1"]).join(rows.toDF("c2", "i2", "two"), ["c2", "i2"]).mapInArrow(_best_pair(threshold), "u long, v long")


def _count_pairs(threshold: float):
    """Rows of two blocks of one component: each vector's links with the other block, by weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one, two = (batch.column(c).slice(k, 1).flatten() for c in ("one", "two"))
                same = batch.column("i")[k].as_py() == batch.column("j")[k].as_py()
                ids, others = one.field("id").to_numpy(), two.field("id").to_numpy()
                hit = _matrix(one.field("v")) @ _matrix(two.field("v")).T >= threshold
                mine, theirs = one.field("weight").to_numpy(), two.field("weight").to_numpy()
                if same:
                    hit &= ids[:, None] != others[None]
                    parts = [(ids, hit @ theirs)]
                else:
                    parts = [(ids, hit @ theirs), (others, mine @ hit)]
                for who, n in parts:
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(n.astype(np.int64))], ["id", "n"])

    return run


def _blocks(member: DataFrame, vectors: DataFrame) -> DataFrame:
    """(component, m, i, rows): each component's members in ``m`` blocks of about ``BLOCK / 2``."""
    sizes = member.groupBy("component").agg(F.ceil(F.count("*") * 2 / F.lit(BLOCK)).cast("int").alias("m"))
    rows = member.join(sizes, "component").join(vectors, F.col("node") == F.col("id"))
    rows = rows.select("component", "m", F.pmod(F.xxhash64("id"), F.col("m")).cast("int").alias("i"), "id", "v", "weight")
    return rows.groupBy("component", "m", "i").agg(F.collect_list(F.struct("id", "v", "weight")).alias("rows"))


def _exact_counts(member: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(id, n_links) inside components, every pair of blocks a row of its own."""
    blocks = materialize(_blocks(member, vectors), "blocks")
    left = blocks.select("component", "i", F.explode(F.sequence("i", F.col("m") - 1)).alias("j"), F.col("rows").alias("one"))
    right = blocks.select("component", F.explode(F.sequence(F.lit(0), "i")).alias("i"), F.col("i").alias("j"), F.col("rows").alias("two"))
    return left.join(right, ["component", "i", "j"]).mapInArrow(_count_pairs(threshold), "id long, n long").groupBy("id").agg(F.sum("n").alias("n_links"))


def _audit(vectors: DataFrame, threshold: float, audit: int, small: int) -> tuple[DataFrame | None, bool]:
    """Links of drawn vectors with all vectors, and whether none was left to draw; no frame if there is no vector.

    Draws double until ``LINKED`` drawn vectors have 1 to ``small`` links or ``DRAWS * audit`` are drawn.
    """
    order = F.struct(F.xxhash64("id", F.lit(3)), "id")
    truth, pool, size, drawn = None, vectors, audit, 0
    while True:
        chosen = pool.select("id", "v", order.alias("o")).orderBy("o").limit(size).collect()
        if not chosen:
            return truth, True
        queries = np.array([r["id"] for r in chosen]), np.array([r["v"] for r in chosen])
        part = materialize(vectors.mapInArrow(_links_of(queries, threshold), _EDGE), "audit-links")
        truth = part if truth is None else truth.union(part)
        drawn += len(chosen)
        if len(chosen) < size:
            return truth, True
        if drawn >= DRAWS * audit or truth.groupBy("a").count().where(F.col("count") <= small).count() >= LINKED:
            return truth, False
        last = chosen[-1]["o"]
        later = F.xxhash64("id", F.lit(3))
        pool = vectors.where((later > last[0]) | ((later == last[0]) & (F.col("id") > last[1])))
        pool = pool.join(truth.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
        size *= 2


def _recall(truth: DataFrame, member: DataFrame) -> float | None:
    """Mean share of a query's links inside its component, of the size of group (powers of two) where it is least."""
    side = lambda end, c: member.select(F.col("node").alias(end), F.col("component").alias(c))
    held = truth.select("a", "b").join(side("a", "ca"), "a", "left").join(side("b", "cb"), "b", "left")
    each = held.groupBy("a").agg(F.count("*").alias("n"), F.count(F.when(F.col("ca") == F.col("cb"), 1)).alias("hit"))
    sizes = each.groupBy(F.floor(F.log2("n")).alias("size")).agg(F.avg(F.col("hit") / F.col("n")).alias("share"))
    return sizes.agg(F.min("share")).first()[0]


def near_duplicates(table: DataFrame, threshold: float = 0.9, k: int = NEIGHBOURS, rounds: int = ROUNDS, audit: int = 1024) -> DataFrame:
    """``table(vec_id, embedding, ...)`` -> (vec_id, n_links, component_id, kept, recall), one row per input row.

    ``audit`` is the first number of query vectors of the recall audit (a choice by hash of the id); ``recall`` is the
    share of a query's links, by comparison with all vectors, that the components hold, in groups of the worst size.
    """
    given = materialize(_vectors(table), "given-vectors")
    # A class of equal vectors goes by its smallest id; of several classes with one smallest id, all but one go by a hash.
    several = materialize(given.groupBy("id").agg(F.count("*").alias("n"), F.min(F.xxhash64("v")).alias("keep")).where("n > 1").drop("n"), "several-vectors")
    hint = F.broadcast(several) if several.count() <= BROADCAST_KEYS // 2 else several
    classes = given.join(hint, "id", "left").groupBy("v").agg(
        F.min("id").alias("first"), F.count("*").alias("weight"), F.count("keep").alias("odd"), F.min_by("keep", "id").alias("keep")
    )
    own = F.when(F.xxhash64("v") != F.col("keep"), F.xxhash64("v")).otherwise(F.col("first"))
    classes = materialize(classes.select(own.alias("id"), "v", "weight", "first", "odd"), "vectors")
    vectors = classes.select("id", "v", "weight")
    repeated = classes.where("weight > 1 OR odd > 0").select(F.col("id").alias("first"), "v", "weight")
    copies = materialize(given.join(repeated, "v").select(F.col("id").alias("vid"), "first", "weight"), "copies")
    same_id = copies.join(several.select(F.col("id").alias("vid")), "vid").groupBy("vid").agg(F.min("first").alias("u"), F.collect_list("first").alias("all"))
    same_id = same_id.select("u", F.explode("all").alias("v")).where("u <> v")
    truth, whole = _audit(vectors, threshold, audit, k)
    first = vectors.select(F.size("v")).first()
    width, n = (first[0], vectors.count()) if first else (0, 0)
    if truth is None:
        truth = table.sparkSession.createDataFrame([], _EDGE)
    graph, recall = None, 1.0 if whole else None
    links = truth.select(F.col("a").alias("u"), F.col("b").alias("v"))
    member = components(links)
    for attempt in range(ATTEMPTS if width else 0):
        orders = vectors.mapInArrow(_orders(width, TABLES, 100 + attempt, _bits(n)), "t int, key long, id long, v array<double>")
        start = orders.repartitionByRange("t", "key", "id").sortWithinPartitions("t", "key", "id").mapInArrow(_adjacent(REACH, k), _EDGE)
        graph = materialize(_top(start if graph is None else start.union(graph.select("a", "b", "cos")), k), "neighbours")
        for _ in range(rounds):
            wider = _top(graph.select("a", "b", "cos").union(_descend(graph, vectors, k, max(4, k // 2))), k)
            after = materialize(wider, "neighbours")
            discard(graph)
            graph = after
        found = graph.where(F.col("cos") >= threshold).select(F.col("a").alias("u"), F.col("b").alias("v"))
        member = materialize(components(found), "found-components")
        across = materialize(_saturated_links(graph, member, vectors, threshold, k), "saturated-links")
        if not across.isEmpty():
            found = found.union(across)
            member = materialize(components(found), "found-components")
        measured = _recall(truth, member)
        recall = recall if measured is None else measured
        if measured is None or measured >= (RECALL if attempt < 3 else FLOOR):
            break
        k, rounds = min(2 * k, 8 * NEIGHBOURS) if k < 8 * NEIGHBOURS else k, 1
    else:
        if width:
            raise RuntimeError(f"the links found hold {recall:.3f} of the audited ones after {ATTEMPTS} attempts")
    if graph is not None:
        member = materialize(components(found.union(links).union(same_id)), "all-components")
        saturated = _exact_counts(member, vectors, threshold)
    else:
        saturated = table.sparkSession.createDataFrame([], "id long, n_links long")
    counts = materialize(saturated, "link-counts")
    component = member.select(F.col("node").alias("first"), "component")
    if several.count():  # a class may go by a hash: components are named by their smallest id
        named = component.join(classes.select(F.col("id").alias("first"), F.col("first").alias("least")), "first")
        component = named.join(named.groupBy("component").agg(F.min("least").alias("name")), "component").select("first", F.col("name").alias("component"))
    # Ids that share a vector or have several, by their classes; all others are their own class.
    shared = (
        copies.join(counts.withColumnRenamed("id", "first"), "first", "left").join(component, "first", "left").groupBy("vid")
        .agg(F.sum(F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_shared"), F.min("component").alias("c_shared"), F.min("first").alias("least"))
    )
    out = (
        table.select(F.col("vec_id"), F.col("vec_id").cast("long").alias("vid")).join(shared, "vid", "left")
        .join(counts.withColumnRenamed("id", "vid"), "vid", "left").join(component.withColumnRenamed("first", "vid"), "vid", "left")
    )
    name = F.coalesce("c_shared", F.when(F.col("least").isNotNull(), F.col("least")).otherwise(F.coalesce("component", "vid")))
    return out.select(
        "vec_id", F.coalesce("n_shared", "n_links", F.lit(0)).cast("long").alias("n_links"), name.alias("component_id"),
        (name == F.col("vid")).alias("kept"), F.lit(recall).cast("double").alias("recall"),
    )
