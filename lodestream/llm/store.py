"""Shared scratch space: how the operators cut lineage and survive lost executors.

An intermediate result is written once as Parquet below the folder that the
session names in ``spark.checkpoint.dir`` and read back, so that later stages
never recompute it and no single executor holds the only copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.session import new_path, shared_dir

#: Rows up to which a list of 8-byte keys is broadcast (at most 64 MB of hash table).
BROADCAST_KEYS = 2_000_000

#: Bytes and rows of an Arrow batch between Spark and Python, unless the session sets less.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 1000

#: The shared folder of a session, and a fresh name in it.
scratch_dir = shared_dir
__all__ = ["BATCH_BYTES", "BATCH_ROWS", "BROADCAST_KEYS", "bounded_batches", "columns_of", "discard", "keys_hint", "materialize", "new_path", "scratch_dir"]


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to the bounds above, for workers that hold a batch beside their own arrays."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = str(spark.conf.get(key)).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and return the rows as read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized frame that nothing will read again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lodestream/" in path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def keys_hint(keys: DataFrame) -> DataFrame:
    """``keys`` (one 8-byte column, materialized) marked for broadcast if its counted size allows it."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name cannot clash with working ones."""
    return df.select(*[df[n] for n in names])
