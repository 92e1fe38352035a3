"""One place for the session settings that the results depend on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "8g", name: str = "lodestream") -> SparkSession:
    """A local session for tests and benchmarks: UTC, adaptive execution, as many shuffle partitions as cores."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LODESTREAM_MEMORY", memory))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); one of its own only where none is set and Spark is local."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not conf.get("spark.master", "").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-lodestream-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestream/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task of :func:`dealt`.
TASK_ROWS = 250_000


def dealt(df: DataFrame, counted: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` into as many parts as the rows of ``counted`` need, at least the session's.

    What is grouped, joined or sorted by these keys then stays in its part, whose size does not grow with the table.
    ``counted`` is a stored table, whose rows Spark counts from the footers of its files.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-counted.count() // TASK_ROWS)), *keys)
