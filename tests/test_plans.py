"""Whole analyses and streams on made-up recordings."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isoptic import constants as C
from isoptic import plans, streaming
from isoptic.operators import grid


def recording(seed=0):
    r = np.random.default_rng(seed)
    rows = [(i, float(i * 1000), *(0.5 + 0.01 * np.cumsum(r.normal(size=4))).tolist()) for i in range(1300)]
    rows = [x if i % 97 else (x[0], x[1], *[float("nan")] * 4) for i, x in enumerate(rows)]
    starts, ends = C.PANEL_MESSAGES["KD"]
    marks = [("r", i, float(t), m) for i, (t, m) in enumerate(zip((0, 400_000, 420_000, 800_000, 820_000, 1_290_000), (x for p in zip(starts, ends) for x in p)))]
    return [("r", *x) for x in rows], marks


def test_recording_to_windows(spark):
    rows, marks = recording()
    raw = spark.createDataFrame(rows, "recording_id string, idx long, t_us double, left_x double, left_y double, right_x double, right_y double")
    messages = spark.createDataFrame(marks, "recording_id string, seq int, t_us double, text string")
    about = spark.createDataFrame([("r", "r")], "recording_id string, dom_eye string")
    clean = plans.clean_recording(raw, messages, about, "KD").cache()
    by = ["recording_id", "panel"]
    counts = {r.panel: r["count"] for r in clean.groupBy("panel").count().collect()}
    assert counts == {1: 399, 2: 379, 3: 469}  # both ends are open
    assert clean.where("x is null or y is null").count() == 0
    labelled = plans.label_recording(clean, keys=by)
    assert {r.evt for r in labelled.select("evt").distinct().collect()} <= {1, 2}
    assert labelled.groupBy("panel").agg(F.min("t").alias("t")).where("t <> 0").count() == 0

    def predict(windows):
        one = windows.select(*by, "window", F.explode("samples").alias("s"))
        return one.select(*by, "window", "s.t", F.lit(2).alias("evt"))

    scored = plans.annotate(clean, "model_based", predict=predict, keys=by)
    assert scored.count() == clean.count() and scored.where("evt_pred = 2").count() > 600
    with pytest.raises(ValueError, match="unknown annotation method"):
        plans.annotate(clean, "other")
    with pytest.raises(ValueError, match="weights"):
        plans.annotate(clean, "model_based", keys=by)


def test_speech_timing(spark):
    ev = [("p", q, 2 * i + j, float(100 * i + 40 * j + q), 1 - 2 * j) for q in range(6) for i in range(30) for j in (0, 1)]
    events = spark.createDataFrame(ev, "participant string, panel int, ord int, t double, sentence_breaks int")
    scores = spark.createDataFrame([("p", q, 30.0) for q in range(6)], "participant string, panel int, strike_score double")
    got = plans.speech_timing(events.withColumn("ord", F.col("ord")), ["participant"], ["panel"], scores).collect()
    assert [(r.participant, r["median"], r["std"], r.groups) for r in got] == [("p", 100.0, 0.0, 6)]
    assert plans.speech_timing(events, ["participant"], ["panel"], scores.withColumn("strike_score", F.lit(0.0))).count() == 0


def test_distance_from_targets(spark):
    targets = grid.target_grid(spark)
    at = {r.ord: (r.x / C.SCREEN_WIDTH, r.y / C.SCREEN_HEIGHT) for r in targets.collect()}
    rows, ev, i = [("p", 1, 0, 0.0, 0.5, 0.5, 1)], [], 1
    for k in range(35):
        for _ in range(4):
            rows.append(("p", 1, i, float(i), *at[k], 1))
            i += 1
        rows.append(("p", 1, i, float(i), 0.0, 0.0, 2))
        ev.append(("p", 1, k, float(i), 1))
        i += 1
    samples = spark.createDataFrame(rows, "participant string, panel int, idx long, t double, x double, y double, evt int")
    events = spark.createDataFrame(ev, "participant string, panel int, ord int, t double, sentence_breaks int")
    got = plans.distance_from_targets(samples, events, targets, ["participant"], ["panel"]).first()
    assert got.n == 35 and got["mean"] < 1e-6
    assert plans.distance_from_targets(samples, events, targets, ["participant"], ["panel"], more_than=35).count() == 0


def test_streams(spark, tmp_path):
    rows = pd.DataFrame({"ts": pd.to_datetime("2024-01-01") + pd.to_timedelta([0, 60, 120, 4000, 4060, 90000], unit="s"), "user": ["a", "a", "b", "a", "a", "a"], "n": range(6), "v": [1, 1, 2, 3, 3, 1]})
    spark.createDataFrame(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("ts timestamp, user string, n long, v long").parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    got = run(streaming.gap_sessions(stream(), "ts", ["user"], "10 minutes"), "append", "sessions")
    assert sorted((r.user, r.n) for r in got) == [("a", 2), ("a", 2), ("b", 1)]  # the last one is still open
    got = run(streaming.tumbling_features(stream(), "ts", "v", ["user"]), "append", "features")
    assert sum(r.n for r in got) == 5
    heat = {r.user: r.heat for r in run(streaming.decayed_counts(stream(), "user", "n"), "update", "heat")}
    assert np.isclose(heat["a"], sum(0.99**k for k in range(5))) and heat["b"] == 1
    assert sorted((r.user, r.v, r.n) for r in run(streaming.run_lengths(stream(), "user", "n", "v"), "append", "runs")) == [("a", 1, 2), ("a", 3, 2)]


def test_idle_series_end(spark, tmp_path):
    at = lambda s: pd.to_datetime("2024-01-01") + pd.to_timedelta(s, unit="s")
    parts = [[("a", 0, 1, 0), ("a", 1, 1, 10), ("b", 2, 5, 20)], [("b", 3, 5, 40_000)], [("b", 4, 6, 80_000)]]
    for k, rows in enumerate(parts):
        part = pd.DataFrame([(u, n, v, at(s)) for u, n, v, s in rows], columns=["user", "n", "v", "ts"])
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("user string, n long, v long, ts timestamp").parquet(str(tmp_path / "in"))
        for name, df, mode in (("runs", streaming.run_lengths(stream, "user", "n", "v", "ts", 600.0, "1 minute"), "append"), ("heat", streaming.decayed_counts(stream, "user", "n", 0.5, "ts", 600.0, "1 minute"), "update")):
            saved = lambda batch, _, name=name, k=k: batch.write.mode("append").parquet(str(tmp_path / f"{name}-{k}"))
            df.writeStream.foreachBatch(saved).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    runs = [(r.user, r.v, r["n"]) for k in range(3) for r in spark.read.schema("user string, v long, n long").parquet(str(tmp_path / f"runs-{k}")).collect()]
    # The run of a, idle, has ended; those of b were cut by its own long pauses.
    assert sorted(runs)[0] == ("a", 1, 2) and all(r[0] in "ab" for r in runs)
