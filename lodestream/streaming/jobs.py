"""Structured Streaming jobs over the click-stream: counters, rollups, sessions, alerts, late enrichment."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestream.sources.sinks import rebuild_days

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Events of the Parquet files of a folder, in event time."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "3 hours") -> DataFrame:
    """Views and values per hour and type; rows later than ``late`` are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def trailing(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A half hour window that moves by ten minutes."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "30 minutes", "10 minutes"))
    return w.agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("active")).select(F.col("window.end").alias("until"), "n", "active")


def user_sessions(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Sessions that end after 30 idle minutes."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", "30 minutes"), "user_id")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("seconds")).select("user_id", F.col("session_window.start").alias("begun"), "n", "seconds")


def first_alerts(events: DataFrame, level: float = 80, late: str = "12 hours") -> DataFrame:
    """One alert per type and user within ``late``."""
    hot = events.where(F.col("value") > level).withWatermark("ts", late)
    return hot.dropDuplicatesWithinWatermark(["event_type", "user_id"]).select("event_id", "event_type", "user_id", "ts")


def enriched(views: DataFrame, exits: DataFrame, within: str = "30 minutes") -> DataFrame:
    """Views with the exit that follows within a time bound; views without one come out when the bound has passed."""
    v = views.select("event_id", F.col("user_id").alias("u"), F.col("ts").alias("seen")).withWatermark("seen", within)
    e = exits.select(F.col("event_id").alias("exit_id"), F.col("user_id").alias("xu"), F.col("ts").alias("left_at"), F.col("value").alias("seconds")).withWatermark("left_at", within)
    on = (F.col("u") == F.col("xu")) & (F.col("left_at") >= F.col("seen")) & (F.col("left_at") <= F.col("seen") + F.expr(f"INTERVAL {within}"))
    return v.join(e, on, "leftOuter").select("event_id", "exit_id", "seconds")


def error_streaks(events: DataFrame, most: int = 3) -> DataFrame:
    """Users whose consecutive errors reach ``most``; the streak is kept per user and ends with any other event."""
    return events.groupBy("user_id").applyInPandasWithState(_streak(most), "user_id long, event_id long, streak int", "streak int", "append", GroupStateTimeout.NoTimeout)


def _streak(most: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, out = (state.get[0] if state.exists else 0), []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for event, kind in zip(rows["event_id"], rows["event_type"], strict=True):
            streak = streak + 1 if kind == "error" else 0
            if streak and streak % most == 0:
                out.append((key[0], event, streak))
        state.update((streak,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "streak"])

    return run


def write_daily(events: DataFrame, path: str, checkpoint: str):
    """Whole-day rebuilds from a stream: each micro-batch recomputes the days that it touches from all rows seen so far.

    Batches that are run again leave the same result.
    """
    raw = f"{path}/raw"

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = rows.withColumn("day", F.to_date("ts").cast("string")).withColumn("batch", F.lit(number))
        days = [r["day"] for r in rows.select("day").distinct().collect()]  # the days of one batch
        if not days:
            return
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(raw)
        every = spark.read.parquet(raw).where(F.col("day").cast("string").isin(days)).withColumn("day", F.col("day").cast("string"))  # only their folders are read
        rebuild_days(every.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")), f"{path}/daily")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
