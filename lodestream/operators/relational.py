"""Relational operators: latest rows, as-of joins, caps per group, pages, spines, rank statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the largest by ``order``. A map-side aggregate, so hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark limits groups inside tasks before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, value: str, tie: str, name: str) -> DataFrame:
    """Each left row with the last ``value`` of its keys at or before its time: one sort of both sides, no range join.

    ``tie`` is a right column that orders equal times. Left columns pass through; ``name`` is null without a match.
    """
    ts, mark = "_ts", "_side"
    a = left.withColumn(ts, F.col(left_ts)).withColumn(mark, F.lit(1)).withColumn("_value", F.lit(None).cast(right.schema[value].dataType)).withColumn("_tie", F.lit(None).cast(right.schema[tie].dataType))
    b = right.select(*keys, F.col(right_ts).alias(ts), F.lit(0).alias(mark), F.col(value).alias("_value"), F.col(tie).alias("_tie"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(ts, mark, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn(name, F.last(F.when(F.col(mark) == 0, F.col("_value")), ignorenulls=True).over(w))
    return seen.where(F.col(mark) == 1).drop(ts, mark, "_value", "_tie")


def asof_within(left: DataFrame, right: DataFrame, keys: Sequence[str], left_day: str, right_day: str, days: int, forward: bool, value: str, name: str) -> DataFrame:
    """Each left row with the nearest right value at most ``days`` after (forward) or before its date.

    Dates fall into buckets of ``days + 1`` days; a row can only match in its own bucket and the next one, so the range
    becomes an equi join on the keys and the bucket.
    """
    width = days + 1
    bucket = lambda c: F.floor(F.unix_date(c) / width)
    step = 1 if forward else -1
    ask = left.select(*keys, F.col(left_day).alias("_l")).distinct()  # equal questions are asked once
    probe = ask.select(*keys, "_l", F.explode(F.array(bucket(F.col("_l")), bucket(F.col("_l")) + step)).alias("_b"))
    b = right.select(*keys, F.col(right_day).alias("_r"), F.col(value).alias("_v"), bucket(F.col(right_day)).alias("_b"))
    gap = F.datediff("_r", "_l") * step
    best = probe.join(b, [*keys, "_b"]).where(gap.between(0, days)).groupBy(*keys, "_l").agg(F.min_by(F.struct("_r", "_v"), F.struct(gap, "_v")).alias("_m"))
    return left.withColumn("_l", F.col(left_day)).join(best, [*keys, "_l"], "left").select(*left.columns, F.col("_m._v").alias(name), F.col("_m._r").alias(f"{name}_day"))


#: Ranges of values whose counts :func:`ranked_values` takes.
RANGES = 4096


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, picks: dict[str, Column]) -> DataFrame:
    """Per key the values at given places (0-based, as columns of ``n``) of the sorted list, exactly.

    Equal values are counted before the shuffle. Counts of ``RANGES`` ranges of values tell in which range a place
    lies, and only the values of those ranges are sorted, a task a range: no task sorts a key's values.
    """
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    span = counted.groupBy(*keys).agg(F.min(value).alias("_min"), F.max(value).alias("_max"), F.sum("_c").alias("n"))
    part = F.floor((F.col(value) - F.col("_min")).cast("double") / F.nullif((F.col("_max") - F.col("_min")).cast("double"), F.lit(0.0)) * RANGES)
    ranged = counted.join(span, keys).withColumn("_k", F.least(F.coalesce(part, F.lit(0)), F.lit(RANGES - 1)).cast("int"))
    sizes = ranged.groupBy(*keys, "_k").agg(F.sum("_c").alias("_m"), F.max("n").alias("_n"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # RANGES rows a key at most
    sizes = sizes.withColumn("n", F.col("_n")).withColumn("_before", before)
    holds = F.lit(False)
    for place in picks.values():
        holds = holds | ((place >= F.col("_before")) & (place < F.col("_before") + F.col("_m")))
    some = ranged.join(sizes.where(holds).select(*keys, "_k", "_before"), [*keys, "_k"])
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_k").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    rows = some.withColumn("_hi", F.col("_before") + upto).withColumn("_lo", F.col("_hi") - F.col("_c"))
    chosen = [F.max(F.when((place >= F.col("_lo")) & (place < F.col("_hi")), F.col(value))).alias(name) for name, place in picks.items()]
    return rows.groupBy(*keys).agg(F.max("n").alias("n"), *chosen)


def day_spine(df: DataFrame, day: str) -> DataFrame:
    """Every day from the first to the last of ``df``."""
    return df.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias(day))


def changed_only(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before in their group (nulls compare as values)."""
    before = F.lag(F.struct(value)).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_b", before).where(F.col("_b").isNull() | ~F.col(f"_b.{value}").eqNullSafe(F.col(value))).drop("_b")


def keyset_page(df: DataFrame, order: Sequence[str], after: Sequence, size: int) -> DataFrame:
    """The rows after a cursor in descending order, with a flag whether more follow; one row over the page is read."""
    cursor = F.struct(*[F.lit(v).alias(c) for c, v in zip(order, after, strict=True)])
    rows = df.where(F.struct(*order) < cursor).orderBy(*[F.desc(c) for c in order]).limit(size + 1)
    w = Window.orderBy(*[F.desc(c) for c in order])  # over at most size + 1 rows
    return rows.withColumn("place", F.row_number().over(w)).withColumn("has_more", F.max("place").over(Window.partitionBy()) > size).where(F.col("place") <= size)


def sessions(df: DataFrame, user: str, ts: str, tie: str, minutes: int = 30) -> DataFrame:
    """Number of each row's session: a gap of ``minutes`` or more begins a new one."""
    w = Window.partitionBy(user).orderBy(ts, tie)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(F.col(ts).cast("timestamp")).over(w))
    opens = F.when(gap.isNull() | (gap >= minutes * 60_000_000), 1).otherwise(0)
    return df.withColumn("_o", opens).withColumn("session_no", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_o")


def unpivot_dims(df: DataFrame, dims: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """A row per dimension (``dimension``, ``value``) and one for the total; one pass instead of one job per dimension."""
    pairs = [F.struct(F.lit("total").alias("dimension"), F.lit("").alias("value"))]
    pairs += [F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("")).alias("value")) for d in dims]
    return df.select(*keep, F.explode(F.array(*pairs)).alias("_d")).select(*keep, "_d.dimension", "_d.value")
