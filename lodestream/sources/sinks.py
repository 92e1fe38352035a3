"""Writes with the semantics of the service: upserts, counters, whole-day rebuilds, pruning, revisions, versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.operators.relational import latest_per_key


def upserted(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The table after an upsert: per key the change with the largest ``order``, else the row that was there."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest_per_key(both, keys, ["_new", order]).select(*current.columns)


def counted(current: DataFrame, increments: DataFrame, keys: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """The table after adding increments to its counters."""
    return current.unionByName(increments).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def rebuild_days(rows: DataFrame, path: str, days: Sequence[str] = ()) -> None:
    """Replace whole ``day`` partitions; running it again leaves the same files' worth of rows.

    Days named in ``days`` that have no rows any more are emptied.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    if days:
        spark = rows.sparkSession
        filled = {str(r["day"]) for r in rows.select("day").distinct().where(F.col("day").cast("string").isin(list(days))).collect()}
        fs = spark._jvm.org.apache.hadoop.fs
        for day in set(days) - filled:
            at = fs.Path(f"{path}/day={day}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def pruned(rows: DataFrame, day: str, today: str, retention: object, default: int = 180) -> DataFrame:
    """Rows within the retention; a setting that is no positive number counts as the default."""
    keep = int(retention) if str(retention).isdigit() and int(str(retention)) > 0 else default
    return rows.where(F.col(day) >= F.date_sub(F.lit(today).cast("date"), keep))


def change_only(snapshots: DataFrame, fresh: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Fresh rows that differ from the latest snapshot of their key, to be appended."""
    last = latest_per_key(snapshots.select(*keys, order, *values), keys, [order]).select(*keys, F.struct(*values).alias("_last"))
    j = fresh.join(last, list(keys), "left")
    return j.where(F.col("_last").isNull() | ~F.col("_last").eqNullSafe(F.struct(*values))).select(*fresh.columns)


def revised(stored: DataFrame, arrivals: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Appends and conflicts of arriving observations (value, status, vintage) against all stored revisions.

    The same vintage is unchanged if value and status are equal, else a conflict. For other vintages the latest
    revision counts: equal value and status are unchanged, whatever the vintage; a later vintage gets the next
    revision number; an earlier one is a conflict.
    """
    held = stored.select(*keys, "vintage", F.struct("value", "status").alias("_x"))
    told = F.struct("value", "status")
    known = arrivals.join(held, [*keys, "vintage"], "left")
    clash = known.where(F.col("_x").isNotNull() & ~F.col("_x").eqNullSafe(told)).select(*arrivals.columns)
    last = latest_per_key(stored.select(*keys, "value", "status", "vintage", "revision_no"), keys, ["vintage"])
    j = known.where("_x IS NULL").drop("_x").join(last.select(*keys, F.struct("value", "status", "vintage", "revision_no").alias("_s")), list(keys), "left")
    w = Window.partitionBy(*keys).orderBy("vintage")
    # Each arrival is held against the one before it, the first against the store.
    before = F.coalesce(F.lag(F.struct("value", "status", "vintage")).over(w), F.when(F.col("_s").isNotNull(), F.struct("_s.value", "_s.status", "_s.vintage")))
    j = j.withColumn("_b", before)
    same = F.col("_b").isNotNull() & F.col("_b.value").eqNullSafe(F.col("value")) & F.col("_b.status").eqNullSafe(F.col("status"))
    same = same | (F.col("_s").isNotNull() & F.struct("_s.value", "_s.status").eqNullSafe(told) & (F.col("vintage") < F.col("_s.vintage")))
    late = F.col("_b").isNotNull() & ~same & ((F.col("vintage") <= F.col("_b.vintage")) | (F.col("_s").isNotNull() & (F.col("vintage") < F.col("_s.vintage"))))
    base = F.coalesce(F.col("_s.revision_no") + 1, F.lit(0))
    fresh = j.where(~same & ~late).withColumn("revision_no", (base + F.row_number().over(w) - 1).cast("long"))
    return fresh.select(*arrivals.columns, "revision_no"), j.where(late).select(*arrivals.columns).unionByName(clash)


def replace_if_better(current: DataFrame, fresh: DataFrame, key: str, text: str) -> DataFrame:
    """Fresh documents with the action taken: insert, replace (longer by 500 characters and a tenth at least), or duplicate."""
    have = current.select(key, F.length(text).alias("_n"))
    grown = F.length(text) - F.col("_n")
    action = F.when(F.col("_n").isNull(), "insert").when(grown >= F.greatest(F.lit(500), F.col("_n") * 0.1), "replace").otherwise("duplicate")
    return fresh.join(have, key, "left").withColumn("action", action).drop("_n")


def compare_and_set(current: DataFrame, updates: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Updates whose ``version`` is the stored one, with the next version; the others as conflicts."""
    j = updates.join(current.select(key, F.col("version").alias("_v")), key, "left")
    fits = F.coalesce(F.col("version") == F.col("_v"), F.lit(False))
    return j.where(fits).withColumn("version", F.col("version") + 1).drop("_v"), j.where(~fits).drop("_v")


def frozen(existing: DataFrame, fresh: DataFrame, key: str, column: str) -> DataFrame:
    """Fill a column only where it is null: what is set once stays."""
    return existing.join(fresh.select(key, F.col(column).alias("_f")), key, "left").withColumn(column, F.coalesce(column, "_f")).drop("_f")


def write_shards(rows: DataFrame, shard: str, path: str) -> None:
    """A folder per shard, each written by one task of its own shard only."""
    rows.repartition(F.col(shard)).write.mode("overwrite").partitionBy(shard).parquet(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
