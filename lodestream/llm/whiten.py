"""Embedding whitening (operator 11): leading components by spectrum slicing.

Each entry c of a vector becomes the whole number floor(1024 * c) + 100000. Tasks
add up these numbers, then the products of the centred ones, without any
rounding: a number is centred on the rounded mean of its dimension, cut into
limbs of ``LIMB`` bits, and limbs are multiplied as doubles in blocks so small
that every sum is a whole number below 2**53. The covariance is one correctly
rounded division of whole numbers an entry, the same on any partitioning.

The driver holds that matrix only (its size is the square of the dimension). The
number of eigenvalues above a shift is the number of positive pivots in the
LDLᵀ factors of the shifted matrix (Sylvester's law of inertia); bisection of
the spectrum by these counts isolates each leading eigenvalue in an interval of
its own, Rayleigh quotient iteration from the middle of the interval finds it,
and the counts on either side of what was found certify its number. Eigenvalues
that no shift tells apart in double precision are taken together: their vectors
are a basis of their common space.

Null vectors, and those with a null or non-finite entry, or one that the whole
numbers cannot hold (2**50 and more), are dropped; so are vectors without
entries, and those whose length is not the commonest one (of equally common
lengths the largest counts): one covariance has one dimension. Repeated rows and
null ids stay and count as often as they occur. Components whose eigenvalue is 0
to double precision cannot be scaled and are left out, so fewer than ``k`` come
back from vectors that span fewer dimensions, and none (no rows) from equal
vectors, from one vector or from an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.store import materialize

SCALE, SHIFT, MOST = 1024, 100_000, 2.0**50
COMPONENTS = 8
#: Bits of a limb, and rows of a block: products of limbs of a block sum below 2**53.
LIMB, BLOCK = 20, 4096
EPS = float(np.finfo(np.float64).eps)


# --- the spectrum of one symmetric matrix ---------------------------------------------------------


def inertia(a: np.ndarray) -> tuple[int, int, int]:
    """Numbers of positive, zero and negative eigenvalues: signs of the pivots of LDLᵀ with one- and two-row pivots."""
    a = np.array(a, np.float64)
    plus = zero = minus = 0
    alpha = (1 + 17**0.5) / 8
    while len(a):
        if len(a) == 1:
            two = False
        else:
            r = 1 + int(np.argmax(np.abs(a[1:, 0])))
            most = abs(a[r, 0])
            two = False
            if most and abs(a[0, 0]) < alpha * most:
                other = np.abs(a[r]).copy()
                other[r] = 0
                sigma = other.max()
                if abs(a[0, 0]) * sigma < alpha * most * most:
                    two = abs(a[r, r]) < alpha * sigma
                    to = 1 if two else 0
                    a[[to, r]] = a[[r, to]]
                    a[:, [to, r]] = a[:, [r, to]]
        if two:
            block, side = a[:2, :2], a[2:, :2]
            plus, minus = plus + 1, minus + 1  # such a block has a negative determinant
            a = a[2:, 2:] - side @ np.linalg.solve(block, side.T)
        else:
            d, side = a[0, 0], a[1:, 0]
            plus, zero, minus = plus + (d > 0), zero + (d == 0), minus + (d < 0)
            a = a[1:, 1:] - np.outer(side, side / d) if d else a[1:, 1:]
        a = (a + a.T) / 2
    return int(plus), int(zero), int(minus)


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``v`` are larger than ``shift``."""
    return inertia(v - shift * np.eye(len(v)))[0]


def slices(v: np.ndarray, k: int, width: float) -> list[tuple[float, float, int, int]]:
    """Intervals (low, high, first, last) that hold eigenvalues number ``first`` to ``last``, falling, up to number ``k``.

    An interval holds one eigenvalue, or several that lie within ``width``.
    """
    size = float(np.abs(v).sum(axis=1).max())
    found, open_ = [], [(-2 * size - width, 2 * size + width, len(v), 0)]
    while open_:
        low, high, c_low, c_high = open_.pop()
        if c_low == c_high or c_high >= k:
            continue
        middle = low + (high - low) / 2
        if c_low - c_high == 1 or high - low <= width or not low < middle < high:
            found.append((low, high, c_high + 1, c_low))
            continue
        c = above(v, middle)
        c = min(max(c, c_high), c_low)
        open_ += [(low, middle, c_low, c), (middle, high, c, c_high)]
    return sorted(found, key=lambda x: x[2])


def _solve(m: np.ndarray, b: np.ndarray, size: float) -> np.ndarray:
    """m⁻¹ b; an exactly singular matrix is moved by less than its rounding."""
    try:
        return np.linalg.solve(m, b)
    except np.linalg.LinAlgError:
        return np.linalg.solve(m + size * EPS * np.eye(len(m)), b)


def _clear(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """``x`` without its share in the known vectors, of length 1."""
    for _ in range(2):
        x = x - known @ (known.T @ x)
    return x / np.linalg.norm(x)


def _quotient_iteration(v: np.ndarray, start: float, size: float, known: np.ndarray, seed: int) -> tuple[float, float, np.ndarray]:
    """Residual, eigenvalue and vector that Rayleigh quotient iteration reaches from a shift."""
    n = len(v)
    x = _clear(np.random.default_rng(seed).standard_normal(n), known)
    for _ in range(2):  # inverse iteration turns a random start towards the interval's vector
        x = _clear(_solve(v - start * np.eye(n), x, size), known)
    best = (np.inf, start, x)
    for _ in range(30):
        rho = float(x @ v @ x)
        rest = float(np.linalg.norm(v @ x - rho * x))
        if rest >= best[0] and best[0] <= 4 * n * EPS * size:
            break
        best = min(best, (rest, rho, x), key=lambda b: b[0])
        if not rest:
            break
        x = _clear(_solve(v - rho * np.eye(n), x, size), known)
    return best


def leading(v: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, list[bool]]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, their unit vectors (columns), and for each whether
    counts on both sides certify its number. Exact ties share a certificate: the counts enclose all of them."""
    n = len(v)
    size = float(np.abs(v).sum(axis=1).max()) if n else 0.0
    values, vectors, sure = [], np.zeros((n, 0)), []
    if not size:
        return np.zeros(0), vectors, sure
    width = 16 * n * EPS * size
    for low, high, first, last in slices(v, k, width):
        if last > first:  # ties: a basis of their space, by inverse iteration of a block
            middle = low + (high - low) / 2
            block = np.random.default_rng(first).standard_normal((n, last - first + 1))
            for _ in range(4):
                block = _solve(v - (middle + width) * np.eye(n), block, size)
                for _ in range(2):
                    block = np.linalg.qr(block - vectors @ (vectors.T @ block))[0]
            own = [float(x @ v @ x) for x in block.T]
            order = np.argsort(own)[::-1]
            certified = above(v, middle - 2 * width) >= last and above(v, middle + 2 * width) < first
            for j in order[: k - len(values)]:
                values.append(own[j])
                vectors = np.column_stack([vectors, block[:, j]])
                sure.append(certified)
            continue
        while True:
            middle = low + (high - low) / 2
            rest, rho, x = _quotient_iteration(v, middle, size, vectors, first)
            if low <= rho <= high and rest <= 4 * n * EPS * size or high - low <= width:
                break
            low, high = (middle, high) if above(v, middle) >= first else (low, middle)  # it went to another one: a narrower start
        values.append(rho)
        vectors = np.column_stack([vectors, x])
        sure.append(above(v, rho - width) >= first and above(v, rho + width) < first)
    return np.array(values), vectors, sure


# --- whole-number sums over all vectors -----------------------------------------------------------


def usable(embeddings: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, x): vectors without null or non-finite entries as whole numbers, whatever their length."""
    values = F.col(column).cast("array<double>")
    fits = F.forall(values, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST))
    return (
        embeddings.select(F.col(id_column).alias("vec_id"), F.col(column)).where(F.col(column).isNotNull()).where(fits)
        .select("vec_id", F.transform(values, lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))
    )


def commonest_length(x: DataFrame) -> int:
    """The length that most vectors have (ties: the largest); 0 if there is none above 0."""
    row = x.select(F.size("x").alias("size")).where("size > 0").groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    return row["size"] if row else 0


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            rows = batch.slice(at, BLOCK)
            yield rows, rows.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Doubles of at most LIMB - 1 bits and a sign, whose sum times powers of 2**LIMB is ``y``."""
    out, half = [], 1 << (LIMB - 1)
    while True:
        limb = ((y + half) & ((1 << LIMB) - 1)) - half
        out.append(limb.astype(np.float64))
        y = (y - limb) >> LIMB
        if not y.any():
            return out


def _added(x: DataFrame, size: int, middle: list[int] | None) -> dict[tuple[int, int], int]:
    """Sums of entries (by (i, -1)), or of products of entries less ``middle`` (by (i, j), i <= j), and the rows at (-1, -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        rows = 0
        upper = np.triu_indices(size)
        for _, block in _blocks(batches, size):
            rows += len(block)
            parts = limbs(block if middle is None else block - np.array(middle, np.int64))
            for a, one in enumerate(parts):
                if middle is None:
                    sums[a] = sums.get(a, 0) + one.sum(axis=0).astype(np.int64)
                    continue
                for b, other in enumerate(parts):
                    sums[a + b] = sums.get(a + b, 0) + (one.T @ other).astype(np.int64)[upper]
        i, j = (np.arange(size), np.full(size, -1)) if middle is None else upper
        columns = [[-1], [-1], [0], [rows]]
        for power, values in sums.items():
            for out, more in zip(columns, (i, j, np.full(len(i), power), values), strict=True):
                out.extend(more.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["i", "j", "power", "value"])

    parts = x.where(F.size("x") == size).select("x").mapInArrow(run, "i long, j long, power long, value long")
    out: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("i", "j", "power").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():  # by dimension, not by rows
        out[r["i"], r["j"]] = out.get((r["i"], r["j"]), 0) + (int(r["value"]) << (LIMB * r["power"]))
    return out


@dataclass
class Whitening:
    """What a fit holds: rows, sums of a dimension, and the components."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    certified: list[bool]

    @property
    def middle(self) -> list[int]:
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]


def fit(x: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """Components of all ``x(vec_id, x)`` of the commonest length; None without any."""
    size = commonest_length(x)
    if not size:
        return None
    first = _added(x, size, None)
    n, sums = first[-1, -1], [first[i, -1] for i in range(size)]
    model = Whitening(n, sums, np.zeros(0), np.zeros((size, 0)), np.zeros(0), [])
    middle = model.middle
    products = _added(x, size, middle)
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    v = np.zeros((size, size))
    trace = 0
    for i in range(size):
        for j in range(i, size):
            exact = n * products[i, j] - rest[i] * rest[j]
            trace += exact if i == j else 0
            v[i, j] = v[j, i] = exact / (n * n)  # whole numbers: correctly rounded
    total = trace / (n * n)
    values, vectors, certified = leading(v, min(k, size))
    keep = [j for j, e in enumerate(values) if e > 16 * size * EPS * total]
    model.values, model.vectors = values[keep], vectors[:, keep]
    model.explained, model.certified = model.values / total if total else model.values, [certified[j] for j in keep]
    return model


def project(x: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, deviation_exact, whitened): deviation is null where a long cannot hold it."""
    size, n, middle, sums = len(model.sums), model.n, model.middle, model.sums
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    basis = model.vectors / np.sqrt(model.values)
    square = sum(s * s for s in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in _blocks(batches, size):
            y = block - np.array(middle, np.int64)
            small = not len(y) or int(np.abs(y).max()) < 1 << 25 and n < 1 << 28
            exact = y if small else y.astype(object)
            own, across = (exact * exact).sum(axis=1), (exact * np.array(rest, np.int64 if small else object)).sum(axis=1)
            deviation = [n * n * int(a) - 2 * n * int(b) + square for a, b in zip(own, across, strict=True)]
            scores = (y - np.array([s / n for s in rest])) @ basis
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("vec_id"),
                    pa.array([d if d < 1 << 63 else None for d in deviation], pa.int64()),
                    pa.array([Decimal(d) if d < 10**38 else None for d in deviation], pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * scores.shape[1], pa.int32()), pa.array(scores.ravel())),
                ],
                ["vec_id", "deviation", "deviation_exact", "whitened"],
            )

    kind = x.schema["vec_id"].dataType.simpleString()
    return x.where(F.size("x") == size).mapInArrow(run, f"vec_id {kind}, deviation long, deviation_exact decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of the ``k`` whitened values less the identity, centred before multiplying."""
    values = [F.col("whitened")[j] for j in range(k)]
    means = whitened.agg(*[F.avg(c) for c in values]).first()
    centred = [c - F.lit(m) for c, m in zip(values, means, strict=True)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    entries = whitened.agg(*[F.avg(centred[i] * centred[j]) for i, j in pairs]).first()
    return max(abs(e - (i == j)) for (i, j), e in zip(pairs, entries, strict=True))


def whitened(embeddings: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact, eigenvalue,
    certified), one row per usable vector and component; ``deviation_exact`` is the decimal that stays where a long is too small."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    x = usable(embeddings)
    model = fit(x, k)
    if model is None or not len(model.values):
        return embeddings.sparkSession.createDataFrame(
            [], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0), eigenvalue double, certified boolean"
        )
    rows = materialize(project(x, model), "whitened")
    error = identity_error(rows, len(model.values))
    each = F.array(*[
        F.struct(F.lit(j + 1).alias("component"), F.lit(float(s)).alias("explained"), F.lit(float(e)).alias("eigenvalue"), F.lit(c).alias("certified"))
        for j, (s, e, c) in enumerate(zip(model.explained, model.values, model.certified, strict=True))])
    return (
        rows.select("vec_id", "deviation", "deviation_exact", F.explode(F.arrays_zip(F.col("whitened"), each.alias("about"))).alias("c"))
        .select(
            "vec_id", F.col("c.about.component").cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("c.whitened").alias("whitened"),
            F.col("c.about.explained").alias("explained"), F.lit(error).alias("identity_error"), "deviation_exact", F.col("c.about.eigenvalue").alias("eigenvalue"), F.col("c.about.certified").alias("certified"),
        )
    )
