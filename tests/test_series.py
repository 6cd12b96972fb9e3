"""Operators against NumPy, over series with the awkward cases."""

import math

import numpy as np
import pytest

from isoptic import constants as C
from isoptic.frames import nan_to_null
from isoptic.operators import align, clean, grid, label, segment, sequence, stats


def frame(spark, series, cols=("v",)):
    rows = [(k, i, *[float(x) for x in np.atleast_1d(v)]) for k, s in series.items() for i, v in enumerate(s)]
    return nan_to_null(spark.createDataFrame(rows, "k string, idx long, " + ", ".join(f"{c} double" for c in cols)).repartition(3))


def back(df, col, order="idx"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.k, r[order])):
        out.setdefault(r.k, []).append(np.nan if r[col] is None else r[col])
    return {k: np.array(v) for k, v in out.items()}


def some(seed=0, n=60, holes=0.1):
    r = np.random.default_rng(seed)
    out = {}
    for k in "abc":
        x = np.cumsum(r.normal(size=n))
        x[r.random(n) < holes] = np.nan
        x[:2] = np.nan
        x[-1] = np.nan
        x[n // 2] = 90.0
        out[k] = x
    out["one"] = np.array([1.0])
    out["flat"] = np.ones(20)
    return out


def mask(x, factor):
    d = np.abs(np.diff(x))
    if not len(d) or np.isnan(d).all():
        return x
    x = x.copy()
    x[1:][d > np.nanstd(d) * factor + np.nanmean(d)] = np.nan
    return x


def fill(x):
    bad = np.isnan(x)
    return x if bad.all() else np.interp(np.arange(len(x)), np.flatnonzero(~bad), x[~bad])


def test_clean(spark):
    data = some() | {"void": np.full(5, np.nan)}
    df = frame(spark, data)
    for got, want in ((clean.mask_outliers(df, ["v"], ["k"], "idx", 3.0), lambda x: mask(x, 3.0)), (clean.interpolate(df, ["v"], ["k"], "idx"), fill), (clean.clean(df, ["v"], ["k"], "idx", 3.0), lambda x: fill(mask(x, 3.0)))):
        for k, v in back(got, "v").items():
            np.testing.assert_allclose(v, want(data[k]), atol=1e-9)
    with pytest.raises(Exception, match="without any known sample"):
        clean.interpolate(df, ["v"], ["k"], "idx", strict=True).collect()


def test_cleaning_sorts_once(spark):
    plan = clean.clean(frame(spark, some()), ["v"], ["k"], "idx")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan


def test_smoothing(spark):
    data = {k: np.nan_to_num(v) for k, v in some().items()}
    for width in (9, 4):
        for k, v in back(clean.smooth(frame(spark, data), ["v"], ["k"], "idx", width), "v").items():
            full = np.convolve(data[k], np.ones(width) / width)
            np.testing.assert_allclose(v, full[(width - 1) // 2 : (width - 1) // 2 + len(data[k])], atol=1e-9)
    ends = back(clean.smooth(frame(spark, {"f": np.ones(30)}), ["v"], ["k"], "idx", 9), "v")["f"]
    np.testing.assert_allclose([ends[0], ends[3], ends[15]], [5 / 9, 8 / 9, 1])


def test_fixations(spark):
    r = np.random.default_rng(3)
    h, v = np.cumsum(r.normal(size=300)) * 0.05 + 5, np.cumsum(r.normal(size=300)) * 0.05 + 3
    got = back(label.fixations(frame(spark, {"a": np.column_stack([h, v])}, ("h", "v")), "h", "v", ["k"], "idx"), "evt")["a"]
    box = np.ones(9) / 9
    h, v = np.convolve(h, box, "same"), np.convolve(v, box, "same")
    speed = np.hypot(np.diff(h) * 600, np.diff(v) * 600)
    angle = np.degrees(np.abs(np.diff(np.arctan2(np.radians(v), np.radians(h)))))
    flag = np.append((speed > 15) & (angle < 30), False)
    assert got.tolist() == [1 if not flag[i : i + 6].any() else 2 for i in range(300)]


def test_runs_rebuild_their_input(spark):
    r = np.random.default_rng(1)
    data = {k: r.integers(0, 3, 40).astype(float) for k in "ab"} | {"one": np.array([2.0])}
    runs = label.run_lengths(frame(spark, data), "v", ["k"], "idx").collect()
    for k, x in data.items():
        own = sorted((y.s, y.e, y.v) for y in runs if y.k == k)
        assert np.concatenate([np.full(e - s, v) for s, e, v in own]).tolist() == x.tolist()
        assert all(a[2] != b[2] and a[1] == b[0] for a, b in zip(own, own[1:]))


def test_savgol_follows_a_quadratic(spark):
    t = np.arange(30.0)
    got = back(label.savgol_velocity(frame(spark, {"a": 3 + 2 * t + 0.5 * t * t, "b": t[:4]}), ["v"], ["k"], "idx", 2.0, 5), "velocity")
    np.testing.assert_allclose(got["a"], (2 + t) * 2, atol=1e-9)
    assert np.isnan(got["b"]).all()


def test_sampling_rate(spark):
    df = frame(spark, {"a": np.arange(50) / 600, "b": np.arange(50) / 57, "one": np.array([0.0])})
    assert {x.k: x.fs for x in label.sampling_rate(df, "v", ["k"], "idx").collect()} == {"a": 600, "b": 60, "one": None}


def test_nearest_and_correlate(spark):
    t = np.array([0.0, 1, 2, 2, 5, 9])
    s = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(t)] + [("b", 0, 4.0)], "k string, idx long, t double")
    ev = [("a", 0, -3.0, 7), ("a", 1, 0.5, 8), ("a", 2, 2.0, 9), ("a", 3, 2.1, 1), ("a", 4, 7.0, 2), ("a", 5, 99.0, 3), ("c", 0, 1.0, 4)]
    e = spark.createDataFrame(ev, "k string, ord long, t double, code int")
    got = {(x.k, x.ord): x.nearest for x in align.nearest_asof(e, s, ["k"], "t", "ord", "idx").collect()}
    assert got == {("a", o): int(np.argmin(np.abs(t - x))) for k, o, x, _ in ev if k == "a"} | {("c", 0): None}
    marked = back(align.correlate(s, e, ["k"], "t", "code", "ord", "idx"), "audio_event")
    assert marked["a"].tolist() == [8, 0, 1, 0, 2, 3] and marked["b"].tolist() == [0]


def test_panels_need_all_messages(spark):
    starts, ends = C.PANEL_MESSAGES["SDMT"]
    rows = [("r", i, float(i * 10), m) for i, m in enumerate([x for p in zip(starts, ends) for x in p])] + [("bad", 0, 0.0, starts[0]), ("r", 9, 99.0, "noise")]
    got = align.panel_intervals(spark.createDataFrame(rows, "recording_id string, seq int, t_us double, text string"), starts, ends).collect()
    assert sorted((x.recording_id, x.ord, x.lo, x.hi, x.duration) for x in got) == [("r", 1, 0, 10, 10), ("r", 2, 20, 30, 10), ("r", 3, 40, 50, 10)]


def test_rms_and_speech(spark):
    r = np.random.default_rng(2)
    loud = np.concatenate([np.zeros(200), np.ones(160) * 0.5, np.zeros(240), np.ones(90) * 0.5]) * r.choice([-1, 1], 690)
    data = {"a": loud, "start": np.concatenate([np.ones(100) * 0.5, np.zeros(300)]), "noisy": np.ones(300) * 0.5}
    df = frame(spark, data)
    for k, v in back(segment.rms_frames(df, "v", ["k"], "idx", 32, 8), "rms", "frame").items():
        x = np.concatenate([np.zeros(16), data[k], np.zeros(16)])
        np.testing.assert_allclose(v, [np.sqrt((x[i * 8 : i * 8 + 32] ** 2).mean()) for i in range(1 + len(data[k]) // 8)], atol=1e-9)
    ev = segment.speech_events(df, "v", ["k"], "idx", 100, 32, 8, 0.25, 0.3).collect()
    by = {}
    for x in sorted(ev, key=lambda x: (x.k, x.ord, -x.sentence_breaks)):
        by.setdefault(x.k, []).append((x.signal_index, x.sentence_breaks))
    assert [s for _, s in by["a"]] == [1, -1, 1, -1] and by["a"][-1] == (689, -1)
    assert by["start"][0] == (0, 1) and "noisy" not in by


def test_windows_and_sessions(spark):
    n, length, stride = 420, 201, 50
    df = frame(spark, {"a": np.arange(n, dtype=float), "short": np.arange(200.0)})
    want = [(p, p + length) if p + length < n else (n - length, n) for p in range(0, n, stride)]
    got = sequence.strided_windows(df, ["k"], "idx", parity=True).orderBy("window").collect()
    assert [(x.lo, x.hi) for x in got] == want and {x.k for x in got} == {"a"}
    rows = sequence.sequences(df, sequence.strided_windows(df, ["k"], "idx"), ["k"], "idx", "v").collect()
    assert sorted((x.lo, [y.v for y in x.samples]) for x in rows) == [(a, list(map(float, range(a, b)))) for a, b in sorted(set(want))]
    t = np.cumsum([1, 1, 1, 9, 1, 1, 1, 1, 9, 1, 9, 1, 1, 1, 1]).astype(float)
    d = frame(spark, {"a": t})
    plain = back(sequence.gap_sessions(d, "v", ["k"], "idx"), "session")["a"]
    assert plain.tolist() == np.cumsum(np.append(0, np.diff(t) > 3)).tolist()
    i, want = 0, []
    for j in np.flatnonzero(np.diff(t) > np.median(np.diff(t) + 2)):
        if j - i < 3:
            i = j
            continue
        want.append(t[i : j + 1].tolist())
        i = j + 1
    found = {}
    for x in sequence.gap_sessions(d, "v", ["k"], "idx", parity=True, least=3).orderBy("idx").collect():
        found.setdefault(x.session, []).append(x.v)
    assert [found[k] for k in sorted(found)] == want


def test_reliability(spark):
    r = np.random.default_rng(5)
    strong = [(f"s{i}", p, float(i + 0.1 * r.normal())) for i in range(20) for p in range(30)]
    noise = [(f"s{i}", p, float(r.normal())) for i in range(20) for p in range(30)]
    curve = lambda rows: stats.reliability_curve(spark.createDataFrame(rows, "subject string, pos int, v double"), 5, 8, 30, 30).orderBy("l").collect()
    assert [x.l for x in curve(strong)] == [5, 6, 7] and all(x.reliability > 0.99 for x in curve(strong))
    assert all(abs(x.reliability) < 0.35 for x in curve(noise))


def test_grids(spark):
    g = grid.target_grid(spark).orderBy("ord").collect()
    assert len(g) == 120 and (g[0].x, g[0].y) == (537, 296) and (g[-1].x, g[-1].y) == (1379, 1034) and g[15].x == 537
    r = np.random.default_rng(4)
    x, y = r.random(500) * 12 - 1, r.random(500) * 12 - 1
    x[0], y[0] = 10.0, 10.0
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0)], "x double, y double")
    h, _, _ = np.histogram2d(x, y, bins=(10, 10), range=((0, 10), (0, 10)))
    cells = grid.histogram_2d(df, "x", "y", 10, 10)
    got = np.zeros((10, 10))
    for c in cells.collect():
        got[c.bx, c.by] = c.n
    np.testing.assert_array_equal(got, h)
    k = grid.gaussian_kernel(1.5)
    rad = len(k) // 2
    want = np.apply_along_axis(lambda v: np.convolve(v, k, "full")[rad : rad + 10], 0, h)
    want = np.apply_along_axis(lambda v: np.convolve(v, k, "full")[rad : rad + 10], 1, want)
    blurred = np.zeros((10, 10))
    for c in grid.gaussian_blur(cells, 10, 10, sigma=1.5).collect():
        blurred[c.bx, c.by] = c.n
    np.testing.assert_allclose(blurred, want, atol=1e-9)


def test_decay(spark):
    cells = [0, 1, 0, 0, 1]
    heat = [0.0, 0.0]
    for c in cells:
        heat = [h * 0.99 for h in heat]
        heat[c] += 1
    df = spark.createDataFrame([("a", i, c, 0) for i, c in enumerate(cells)], "k string, idx long, bx int, by int")
    got = {x.bx: x.heat for x in grid.decayed_heat(df, "bx", "by", "idx", ["k"]).collect()}
    assert all(math.isclose(got[i], heat[i]) for i in (0, 1))


def test_gate_and_parity_quirks(spark):
    df = frame(spark, {"a": np.array([np.nan, 1, 2, 3]), "b": np.array([np.nan, np.nan, 1, 2])}, ("v",))
    assert {x.k for x in clean.quality_gate(df, ["v"], ["k"]).collect()} == {"a"}
    eyes = spark.createDataFrame([("R", 1.0, 2.0), ("r", 1.0, 2.0), ("l", 1.0, 2.0)], "dom_eye string, right_x double, left_x double").selectExpr("*", "0d right_y", "0d left_y")
    assert [x.x for x in clean.dominant_eye(eyes).collect()] == [1, 1, 2] and [x.x for x in clean.dominant_eye(eyes, parity=True).collect()] == [2, 1, 2]
    same = spark.createDataFrame([("a", 2, 2)] * 4, "k string, a int, b int")
    assert stats.agreement(same, "a", "b", ["k"], parity=True).first().agreement == 200 and stats.agreement(same, "a", "b", ["k"]).first().agreement == 100
    scores = spark.createDataFrame([("a", 10, 0), ("b", 10, 10)], "k string, f int, e int")
    assert [x.k for x in stats.ratio_gate(scores, "f", "e").collect()] == ["b"]
