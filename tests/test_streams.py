"""The as-of join of two streams against the batch join."""

import random

import pytest
from pyspark.sql import functions as F

from isoptic import streaming
from isoptic.operators import align
from isoptic.streaming import asof


@pytest.fixture
def stream(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, asof.PROVIDER)
    yield spark
    spark.conf.set(key, before)


SAMPLES, EVENTS = "user long, ts timestamp, idx long", "user long, ts timestamp, event_id long"


def rows(r, users=4, n=120):
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    samples = [(u, at(s), u * 1000 + s) for u in range(users) for s in sorted(r.sample(range(5, 3000), n))]
    events = [(u, at(s), u * 1000 + k) for u in range(users) for k, s in enumerate(sorted(r.choices(range(3000), k=40)))]
    return [(u, t, u * 10_000 + i) for i, (u, t, _) in enumerate(samples)], [(u, t, 100_000 + i) for i, (u, t, _) in enumerate(events)]


def frame(spark, data, schema):
    name = schema.split(", ")[-1].split()[0]
    return spark.createDataFrame([(u, t, i) for u, t, i in data], f"user long, ts string, {name} long").withColumn("ts", F.col("ts").cast("timestamp"))


def written(df, folder, parts):
    """In files by time, so that each is a micro-batch."""
    for k in range(parts):
        lo, hi = k * 3000 // parts, (k + 1) * 3000 // parts
        second = F.minute("ts") * 60 + F.second("ts")
        df.where((second >= lo) & (second < hi)).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, tmp_path, samples, events, **how):
    a = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/samples")
    b = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    out = streaming.nearest_asof(b, a, "user", "ts", "event_id", "idx", **how)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return {(r.user, r.event_id): r.nearest for r in spark.read.schema("user long, event_id long, nearest long").parquet(f"{tmp_path}/out").collect()}, q


def test_the_stream_gives_what_the_batch_join_gives(stream, tmp_path):
    samples, events = rows(random.Random(1))
    # Late rows of all users close what waits.
    tail = [(u, "2024-01-01 03:00:00", 99_990 + u) for u in range(4)]
    s, e = frame(stream, samples + tail, SAMPLES), frame(stream, events + [(9, "2024-01-01 03:00:00", 1)], EVENTS)
    written(s.where("ts < '2024-01-01 01:00:00'"), tmp_path / "samples", 5)
    s.where("ts >= '2024-01-01 01:00:00'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/samples")
    written(e.where("user < 9"), tmp_path / "events", 5)
    e.where("user = 9").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    got, q = run(stream, tmp_path, s, e, late="20 minutes", idle_s=86_400)
    timed = lambda df: df.withColumn("t", F.unix_micros("ts"))
    want = {(r.user, r.event_id): r.nearest for r in align.nearest_asof(timed(e), timed(s), ["user"], "t", "event_id", "idx").collect()}
    del want[9, 1]  # a series without samples
    assert len(want) == len(events) and got == want


def test_state_keeps_what_can_still_be_nearest(stream, tmp_path):
    n = 4000
    base = stream.range(n).select(F.lit(7).cast("long").alias("user"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"), F.col("id").alias("idx"))
    for k in range(4):
        base.where((F.col("idx") >= k * 1000) & (F.col("idx") < (k + 1) * 1000)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/samples")
    base.where("idx % 100 = 50").withColumnRenamed("idx", "event_id").coalesce(1).write.parquet(f"{tmp_path}/events")
    got, _ = run(stream, tmp_path, None, None, late="10 seconds", idle_s=86_400)
    assert got == {(7, i): i for i in range(50, 3940, 100)}  # the watermark is at 3940
    held = stream.read.format("statestore").option("stateVarName", "samples").option("flattenCollectionTypes", "true").load(f"{tmp_path}/state")
    assert held.count() <= 1100  # of 4000: one batch and what the watermark leaves


def test_series_that_fall_idle_end(stream, tmp_path):
    samples = [(1, "2024-01-01 00:00:10", 1), (2, "2024-01-01 20:00:00", 2)]
    events = [(1, "2024-01-01 00:00:30", 5), (3, "2024-01-01 00:00:20", 6), (2, "2024-01-01 21:00:00", 7)]
    frame(stream, samples[:1], SAMPLES).coalesce(1).write.parquet(f"{tmp_path}/samples")
    frame(stream, events[:2], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events")
    frame(stream, events[2:], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    frame(stream, samples[1:], SAMPLES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/samples")
    got, _ = run(stream, tmp_path, None, None, late="1 minute", idle_s=600)
    assert got == {(1, 5): 1}  # the event of user 3 has no sample
    keys = stream.read.format("statestore").option("stateVarName", "samples").option("flattenCollectionTypes", "true").load(f"{tmp_path}/state").select("key.user").distinct().collect()
    assert {r.user for r in keys} <= {2}


def test_other_keys_are_refused(stream):
    df = stream.createDataFrame([], "user double, ts timestamp, idx long")
    with pytest.raises(ValueError, match="long or a string"):
        streaming.nearest_asof(df.withColumnRenamed("idx", "event_id"), df, "user", "ts", "event_id", "idx")
