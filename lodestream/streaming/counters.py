"""Call counters kept in keyed state and written in small batches.

Calls fold into counters of (day, owner, endpoint, status). Counters wait in the
state of their shard, a hash of that key, and leave it together as increments
when ``MOST`` of them wait or ``EVERY`` has passed since the first one came, by a
processing-time timer. Increments add up, so the table that they go to is the
same whatever the flushes were. State holds at most ``MOST`` counters a shard,
also while one batch brings more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST, EVERY, SHARDS = 500, "10 seconds", 16
KEY = ["day", "owner", "endpoint", "status"]
COUNTS = "day string, owner string, endpoint string, status int, calls long, total_ms long"


def endpoint_of(url: Column) -> Column:
    """The path of an address with identifiers folded: runs of digits, and of 16 and more letters and digits, are ``{id}``.

    Cut at 120 characters; an address without scheme and host is ``unknown``.
    """
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+([^?#]*)", 1)
    whole = F.when(path == "", F.lit("/")).otherwise(path)
    folded = F.array_join(F.transform(F.split(whole, "/"), lambda s: F.when(s.rlike("^([0-9]+|[0-9A-Za-z]{16,})$"), "{id}").otherwise(s)), "/")
    known = F.coalesce(url, F.lit("")).rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+")
    return F.when(known, F.left(folded, F.lit(120))).otherwise("unknown")


def calls(rows: DataFrame, at: Column, owner: Column, url: Column, status: Column, ms: Column) -> DataFrame:
    """One counter row a call; a null owner is the empty one, milliseconds are rounded halves up."""
    return rows.select(
        F.date_format(at, "yyyy-MM-dd").alias("day"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), endpoint_of(url).alias("endpoint"), status.cast("int").alias("status"),
        F.lit(1).cast("long").alias("calls"), F.floor(F.coalesce(ms, F.lit(0)) + 0.5).cast("long").alias("total_ms"),
    )


def counters(rows: DataFrame) -> DataFrame:
    """Totals of a bounded table of counter rows."""
    return rows.groupBy(*KEY).agg(F.sum("calls").alias("calls"), F.sum("total_ms").alias("total_ms"))


def increments(stream: DataFrame, most: int = MOST, every: str = EVERY, shards: int = SHARDS) -> DataFrame:
    """A stream of counter rows -> a stream of increments (append), flushed by number of counters or by time."""
    wait = int(pd.Timedelta(every).total_seconds() * 1000)
    dealt = stream.withColumn("shard", F.pmod(F.xxhash64(*KEY), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandasWithState(_folded(most, wait), COUNTS, f"waiting array<struct<{COUNTS.replace(' ', ':').replace(',:', ', ')}>>, since long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _folded(most: int, wait: int):
    columns = [c.split()[0] for c in COUNTS.split(", ")]

    def out(waiting: dict) -> pd.DataFrame:
        return pd.DataFrame([(*k, *v) for k, v in waiting.items()], columns=columns)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        held, since = state.get if state.exists else ([], now)
        waiting = {tuple(r[:4]): [r[4], r[5]] for r in held}
        if state.hasTimedOut:
            state.remove()
            yield out(waiting)
            return
        for frame in frames:
            sums = frame.groupby(KEY, sort=False)[["calls", "total_ms"]].sum()
            for k, n, ms in zip(sums.index, sums["calls"], sums["total_ms"], strict=True):
                if k not in waiting and not waiting:
                    since = now
                mine = waiting.setdefault(k, [0, 0])
                mine[0] += int(n)
                mine[1] += int(ms)
                if len(waiting) >= most:
                    yield out(waiting)
                    waiting = {}
        if not waiting:
            if state.exists:
                state.remove()
            return
        if now - since >= wait:
            state.remove() if state.exists else None
            yield out(waiting)
            return
        state.update(([(*k, *v) for k, v in waiting.items()], since))
        state.setTimeoutDuration(max(1, since + wait - now))

    return run
