"""Streaming jobs over small folders: what they give, and that it equals the batch result."""

import os
import time

import pytest
from pyspark.sql import functions as F

from lodestream.streaming import counters as C
from lodestream.streaming import jobs as J


@pytest.mark.parametrize(("url", "want"), [
    ("https://api.example.org/v1/items/12345?x=1", "/v1/items/{id}"), ("https://api.example.org/v1/items/abcdefghij0123456789", "/v1/items/{id}"), ("https://api.example.org/v1/items/abcdef", "/v1/items/abcdef"),
    ("https://api.example.org", "/"), ("https://api.example.org/a//7/#q", "/a//{id}/"), ("nonsense", "unknown"), (None, "unknown"), ("http://h/" + "x-" * 100, ("/" + "x-" * 100)[:120]),
])
def test_endpoints(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(C.endpoint_of(F.col("u"))).first()[0] == want


def run(spark, folder, name, most, every, files, wait_rows, seconds=60):
    """Feed files one by one; the batches that come out, until ``wait_rows`` calls are counted."""
    schema = "at timestamp, owner string, url string, status int, ms double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    rows = C.calls(stream, F.col("at"), F.col("owner"), F.col("url"), F.col("status"), F.col("ms"))
    seen = []
    q = C.increments(rows, most, every, shards=1).writeStream.foreachBatch(lambda df, n: seen.append(df.collect())).outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        for k, data in enumerate(files):
            (folder / f".{k}").write_text(data)
            os.rename(folder / f".{k}", folder / f"{k}.json")
        end = time.time() + seconds
        while time.time() < end and sum(r.calls for b in seen for r in b) < wait_rows:
            assert q.isActive, q.exception()
            time.sleep(0.2)
        held = q.lastProgress
    finally:
        q.stop()
    total = C.counters(C.calls(spark.read.schema(schema).json(str(folder)), F.col("at"), F.col("owner"), F.col("url"), F.col("status"), F.col("ms")))
    return [b for b in seen if b], {tuple(r) for r in total.collect()}, held


def folded(batches):
    out = {}
    for r in (r for b in batches for r in b):
        n, ms = out.get(tuple(r)[:4], (0, 0))
        out[tuple(r)[:4]] = (n + r.calls, ms + r.total_ms)
    return {(*k, *v) for k, v in out.items()}


def line(k, url):
    return f'{{"at": "2024-01-0{1 + k % 2}T10:00:00", "owner": {"null" if k % 3 else chr(34) + "o" + chr(34)}, "url": "https://h/{url}", "status": 200, "ms": {k}.5}}\n'


def test_flush_by_number_of_counters(spark, tmp_path):
    files = ["".join(line(k, f"p{chr(97 + k % 25)}{n}") for k in range(50)) for n in range(2)]
    batches, want, held = run(spark, tmp_path, "size", 20, "1 hour", files, 80)
    assert sum(map(len, batches)) >= 80 and all(len(b) % 20 == 0 for b in batches)  # only full buffers left before the hour is over
    totals = {w[:4]: w[4:] for w in want}
    assert all(n <= totals[tuple(k)][0] and ms <= totals[tuple(k)][1] for *k, n, ms in folded(batches))


def test_flush_by_time(spark, tmp_path):
    batches, want, _ = run(spark, tmp_path, "time", 500, "3 seconds", ["".join(line(k, "a") for k in range(30)), "".join(line(k, "b") for k in range(9))], 39)
    assert folded(batches) == want and all(len(b) < 20 for b in batches)


# --- event-time jobs: each equals the batch result over the same rows ------------------------------


@pytest.fixture
def folder(spark, sf, tmp_path):
    """The events in two files, the earlier half first."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    half = e.selectExpr("percentile_approx(ts, 0.5) AS t").first().t
    for k, part in enumerate((e.where(F.col("ts") <= half), e.where(F.col("ts") > half))):
        part.coalesce(1).write.parquet(f"{tmp_path}/w{k}")
        name = next(f for f in os.listdir(f"{tmp_path}/w{k}") if f.startswith("part-"))
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        os.rename(f"{tmp_path}/w{k}/{name}", f"{tmp_path}/in/{k}.parquet")
    return f"{tmp_path}/in"


def all_of(stream, mode="append"):
    """Rows that a stream gives over all files that are there (only what its watermark has closed, in append mode)."""
    seen = {}
    q = stream.writeStream.foreachBatch(lambda df, n: seen.update({n: df.collect()})).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return [r for n in sorted(seen) for r in seen[n]]


def events_of(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def test_hours_and_trailing_windows(spark, sf, folder):
    got = {(r.hour, r.event_type): (r.n, round(r.total, 6)) for r in all_of(J.hourly(J.event_stream(spark, folder)))}
    want = {(r.hour, r.event_type): (r.n, round(r.total, 6)) for r in events_of(spark, sf).groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).collect()}
    last = max(h for h, _ in want)
    assert got and all(want[k] == v for k, v in got.items()) and {k for k in want if (last - k[0]).total_seconds() > 5 * 3600} <= set(got)
    windows = {r.until: (r.n, r.active) for r in all_of(J.trailing(J.event_stream(spark, folder)))}
    rows = [(r.ts, r.user_id) for r in events_of(spark, sf).select("ts", "user_id").collect()]
    for until in sorted(windows)[::97]:
        inside = [u for t, u in rows if 0 < (until - t).total_seconds() <= 1800]
        assert windows[until][0] == len(inside) and abs(windows[until][1] - len(set(inside))) <= 1  # the number of users is approximate


def test_sessions_equal_batch(spark, sf, folder):
    got = {(r.user_id, r.begun): r.n for r in all_of(J.user_sessions(J.event_stream(spark, folder)))}
    want, last = {}, max(r.ts for r in events_of(spark, sf).select("ts").collect())
    for r in events_of(spark, sf).orderBy("user_id", "ts").collect():
        key = want.get(r.user_id, [])
        if key and (r.ts - key[-1][1]).total_seconds() < 1800:
            key[-1] = (key[-1][0], r.ts, key[-1][2] + 1)
        else:
            want[r.user_id] = [*key, (r.ts, r.ts, 1)]
    every = {(u, a): (n, b) for u, own in want.items() for a, b, n in own}
    assert got and all(every[k][0] == n for k, n in got.items()) and {k for k, (n, b) in every.items() if (last - b).total_seconds() > 2 * 3600} <= set(got)


def test_alerts_come_once_in_their_time(spark, sf, folder):
    got = all_of(J.first_alerts(J.event_stream(spark, folder)))
    hot = {}
    for r in events_of(spark, sf).where("value > 80").collect():
        hot.setdefault((r.event_type, r.user_id), []).append(r.ts)
    assert {(r.event_type, r.user_id) for r in got} == set(hot)
    by = {}
    for r in sorted(got, key=lambda r: r.ts):
        before = by.get((r.event_type, r.user_id))
        assert before is None or (r.ts - before).total_seconds() > 12 * 3600
        by[r.event_type, r.user_id] = r.ts


def test_late_enrichment_equals_a_join(spark, sf, folder):
    views, exits = (J.event_stream(spark, folder).where(F.col("event_type") == k) for k in ("view", "click"))
    got = {(r.event_id, r.exit_id) for r in all_of(J.enriched(views, exits))}
    e = events_of(spark, sf)
    v, x = e.where("event_type = 'view'").select("event_id", "user_id", "ts"), e.where("event_type = 'click'").select(F.col("event_id").alias("exit_id"), F.col("user_id").alias("u"), F.col("ts").alias("t"))
    pairs = {(r.event_id, r.exit_id) for r in v.join(x, (F.col("user_id") == F.col("u")) & (F.col("t") >= F.col("ts")) & (F.col("t") <= F.col("ts") + F.expr("INTERVAL 30 minutes"))).collect()}
    assert {p for p in got if p[1] is not None} == pairs
    alone = {p[0] for p in got if p[1] is None}
    assert not alone & {p[0] for p in pairs} and len(alone) > 0.8 * (v.count() - len({p[0] for p in pairs}))


def test_error_streaks_equal_batch(spark, sf, folder):
    got = {(r.user_id, r.event_id): r.streak for r in all_of(J.error_streaks(J.event_stream(spark, folder), most=2))}
    want, run = {}, {}
    for r in events_of(spark, sf).orderBy("user_id", "ts", "event_id").collect():
        run[r.user_id] = run.get(r.user_id, 0) + 1 if r.event_type == "error" else 0
        if run[r.user_id] and run[r.user_id] % 2 == 0:
            want[r.user_id, r.event_id] = run[r.user_id]
    assert got == want
