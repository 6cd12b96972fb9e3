"""Clustering, components, windows of a classifier, and what SQL can't say, against plain loops."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoptic import queries
from isoptic.functions import box_muller
from isoptic.operators import align, classifier, clean, grid, sequence, stats, vector
from isoptic.sources import files


def plain_lloyd(rows, k, iterations, seed):
    """By loops: rows are (id, vector)."""
    pick = lambda n, j: min(rows, key=lambda r: hashlib.md5(f"{r[0]}:{seed}:{n}:{j}".encode()).hexdigest())[1]
    centres, own = [pick(0, j) for j in range(k)], {}
    for n in range(1, iterations + 1):
        for i, v in rows:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres]
            own[i] = d.index(min(d))
        new = []
        for j in range(k):
            mine = [v for i, v in rows if own[i] == j]
            new.append([sum(x) / len(mine) for x in zip(*mine, strict=True)] if mine else pick(n, j))
        centres = new
    return centres, own


@pytest.mark.parametrize(("k", "iterations", "distinct"), [(4, 3, 60), (7, 2, 3)])
def test_lloyd_is_that_of_loops(spark, k, iterations, distinct):
    r = np.random.default_rng(k)
    base = np.round(r.normal(size=(distinct, 5)) * 8) / 8  # sums of these are exact, and so are ties
    rows = [(i, [float(x) for x in base[i % distinct]]) for i in range(60)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows] + [(None, rows[0][1], "x"), (99, None, "x"), (98, [1.0], "x"), (97, [None] * 5, "x")], "id long, v array<double>, cluster2 string")
    centres, out = vector.lloyd(df, "id", "v", k, iterations, seed=3)
    want, own = plain_lloyd(rows, k, iterations, 3)
    assert {x.id: x.cluster for x in out.collect()} == own  # with 3 distinct rows, clusters are empty and drawn anew
    assert np.allclose(centres, want)
    mse = np.mean([(a - b) ** 2 for i, v in rows for a, b in zip(v, want[own[i]], strict=True)])
    apart = sum(1 / (math.dist(want[a], want[b]) + 1e-6) for a in range(k) for b in range(a + 1, k))
    assert vector.centroid_loss(out, centres, "v").first().loss == pytest.approx(10_000 * mse + 0.001 * apart)


def test_lloyd_of_nothing_and_of_too_many(spark):
    df = spark.createDataFrame([], "id long, v array<double>")
    centres, out = vector.lloyd(df, "id", "v")
    assert centres == [] and out.collect() == [] and out.columns == ["id", "v", "cluster"]
    with pytest.raises(ValueError, match="between 1 and"):
        vector.lloyd(df, "id", "v", k=0)


def test_sets_that_are_sent_to_every_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(vector, "CENTROIDS", 3)
    monkeypatch.setattr(grid, "TARGETS", 3)
    few = spark.range(4).select(F.col("id").alias("cluster"), F.array(F.lit(1.0)).alias("centroid"), F.array(F.lit(1.0)).alias("v"))
    with pytest.raises(ValueError, match="over 3"):
        vector.nearest_centroid(few, few.select("cluster", "centroid"), "v")
    with pytest.raises(ValueError, match="over 3"):
        vector.pairwise_distances(few, few, "cluster", "cluster", "v")
    targets = few.select(F.col("cluster").alias("ord"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    with pytest.raises(ValueError, match="over 3"):
        grid.nearest_target(targets, targets, "x", "y", ["ord"])


def test_components_are_those_of_a_singular_value_decomposition(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(80, 6)) * [5, 3, 2, 0.5, 0.2, 0.1] + 4
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>")
    _, out = vector.pca(df, "v", 3)
    got = np.array([row.components for row in out.orderBy("id").collect()])
    centred = x - x.mean(axis=0)
    want = centred @ np.linalg.svd(centred)[2][:3].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)


def test_a_seeded_order_is_that_of_its_hash(spark):
    df = spark.range(500).select(F.col("id").alias("a"), (F.col("id") % 3).alias("b"))
    got = [r.a for r in sequence.shuffled(df, "a", seed=4).collect()]
    assert got == [r.a for r in sequence.shuffled(df.repartition(5), "a", seed=4).collect()]
    assert sorted(got) == list(range(500)) and got != sorted(got)
    assert got != [r.a for r in sequence.shuffled(df, "a", seed=5).collect()]
    keys = {r.a: r.h for r in df.select("a", F.xxhash64("a", F.lit(4)).alias("h")).collect()}
    assert got == sorted(keys, key=lambda a: (keys[a], a))


def test_noise_has_the_levels_that_are_asked_for(spark):
    df = spark.range(20_000).select(F.col("id"), F.lit(10.0).alias("x"), F.lit(-3.0).alias("y")).coalesce(1)
    same = sequence.augmented(df, ["x", "y"], (0.0,), seed=1).collect()
    assert all(r.x == 10 and r.y == -3 for r in same)
    out = sequence.augmented(df, ["x", "y"], (2.0,), seed=1).collect()
    x, y = (np.array([r[c] for r in out]) for c in ("x", "y"))
    assert abs(x.mean() - 10) < 0.03 and abs(x.std() - 1) < 0.03 and abs(y.std() - 1) < 0.03 and abs(np.corrcoef(x, y)[0, 1]) < 0.03
    mixed = np.array([r.x for r in sequence.augmented(df, ["x"], (0.0, 4.0), seed=1).collect()]) - 10
    assert abs((mixed == 0).mean() - 0.5) < 0.03 and abs(mixed[mixed != 0].std() - 2) < 0.06
    assert out == sequence.augmented(df, ["x", "y"], (2.0,), seed=1).collect()


def test_rows_without_a_value_are_dropped(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 0.0)], "i int, x double")
    assert [r.i for r in clean.drop_missing(df, "x").orderBy("i").collect()] == [1, 3]


def test_participants_are_found_by_their_folders(spark, tmp_path):
    for path in ("HC/p1/SDMT/a.mat", "HC/p1/SDMT/b.mat", "HC/p2/KD/a.mat", "pwMS/p3/SDMT/x/a.mat", "other.mat"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"x")
    found = files.directories(files.listed(spark, f"file://{tmp_path}"), f"file:{tmp_path}", "SDMT")
    assert sorted(tuple(r) for r in found.collect()) == [("HC", "p1"), ("pwMS", "p3")]


def test_windows_are_classified_and_joined_as_by_a_plain_pass(spark):
    """The registered query: windows, codes by seeded weights, the last window's code."""
    folder = "/root/testdata/sf0.001"
    got = {r.event_id: r.evt_pred for r in queries.classified_windows(spark, folder).collect()}
    w = classifier.seeded_weights(channels=4, hidden=8)
    rows = {}
    for r in queries.events(spark, folder).orderBy("user_id", "event_id").select("user_id", "event_id", "t", "value", "k").collect():
        rows.setdefault(r.user_id, []).append(r)
    want = {r.event_id: 0 for of in rows.values() for r in of}
    for of in rows.values():
        n = len(of)
        if n < 24:
            continue
        starts, at = [], {}
        for p in range(0, n, 12):
            lo = p if p + 24 < n else n - 24
            if lo not in starts:
                starts.append(lo)
        for lo in starts:
            part = of[lo : lo + 24]
            codes = classifier.event_codes(np.array([r.value / 200 for r in part]), np.array([r.k / 100 for r in part]), w)
            at |= {r.t: int(c) for r, c in zip(part, codes, strict=True)}
        want |= {r.event_id: at[r.t] for r in of if r.t in at}
    assert got == want and len(set(want.values())) > 1


def test_heat_of_every_frame_is_that_of_a_whole_grid(spark):
    r = np.random.default_rng(3)
    cells = [(int(a), int(b)) if ok else (None, None) for a, b, ok in zip(r.integers(0, 3, 200), r.integers(0, 2, 200), r.random(200) < 0.9, strict=True)]
    df = spark.createDataFrame([("u", i, a, b) for i, (a, b) in enumerate(cells)], "u string, i long, bx int, by int")
    touched = grid.decayed_frames(df, "bx", "by", "i", ["u"], decay=0.9, frames=180, block=7)
    got = {(x.frame, x.bx, x.by): x.heat for x in touched.collect()}
    heat, want, at = {}, {}, {}
    for i, cell in enumerate(cells[:180]):
        heat = {c: h * 0.9 for c, h in heat.items()}
        if cell[0] is not None:
            heat[cell] = heat.get(cell, 0) + 1
            want[(i, *cell)] = heat[cell]
        if i in (0, 50, 179):
            at |= {(i, *c): h for c, h in heat.items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    frames = {(x.frame, x.bx, x.by): x.heat for x in grid.heat_at(touched, [0, 50, 179], "bx", "by", ["u"], 0.9).collect()}
    assert frames.keys() == at.keys() and all(frames[k] == pytest.approx(at[k]) for k in at)


def test_powers_stay_in_range_over_long_series(spark):
    df = spark.range(60_000).select(F.lit(1).alias("u"), F.col("id").alias("i"), F.lit(0).alias("bx"), F.lit(0).alias("by"))
    last = grid.decayed_frames(df, "bx", "by", "i", ["u"], frames=60_000).orderBy(F.desc("frame")).first()
    assert last.frame == 59_999 and last.heat == pytest.approx(100.0)


def test_frames_of_a_clock_have_the_sample_last_seen(spark):
    rows = [("a", 0.05, 1), ("a", 0.31, 2), ("a", 0.31, 3), ("a", 0.33, 4), ("a", 1.06, 5), ("b", 7.0, 6), ("a", None, 7)]
    df = spark.createDataFrame(rows, "u string, t double, i long")
    got = sorted((r.u, r.frame, round(r.clock, 6), r.i) for r in clean.on_clock(df, ["u"], "t", "i", 10.0).collect())
    # From 0.05 on: the frame of 0.35 has what came by then; 1.05 has the sample of 0.33.
    assert got == [("a", n, round(0.05 + n / 10, 6), 1 if n < 3 else 4) for n in range(11)] + [("b", 0, 7.0, 6)]
    fresh = clean.on_clock(df, ["u"], "t", "i", 10.0, stale=0.2).where("u = 'a'")
    assert sorted(r.frame for r in fresh.collect()) == [0, 1, 2, 3, 4]


def test_reliability_by_blocks_is_that_of_a_loop(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(stats, "SUBJECTS", 7)
    monkeypatch.setattr(stats, "REPETITIONS", 5)
    r = np.random.default_rng(6)
    x = r.normal(size=(23, 30)) + r.normal(size=(23, 1)) * 2 + 1e6
    x[r.random(x.shape) < 0.1] = np.nan
    rows = [(s, p, float(v)) for s in range(23) for p, v in enumerate(x[s]) if not np.isnan(v)] + [(0, 30, 5.0), (None, 1, 1.0)]
    values = spark.createDataFrame(rows, "subject long, pos int, v double")
    got = {(row.l, row.rep): row.r for row in stats.split_half(values, (5, 15, 9), 12, 30, seed=2).collect()}
    assert len(got) == 36
    for rep in range(12):
        order = sorted(range(30), key=lambda p: (((rep * 7919 + p * 104729 + 2) * 2654435761) % 4294967291, p))
        for n in (5, 9, 15):
            a, b = (np.nanmean(x[:, part], axis=1) for part in (order[:n], order[n : 2 * n]))
            assert got[n, rep] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-6)
    with pytest.raises(ValueError, match="halves of 1 to 15"):
        stats.split_half(values, (16,), 12, 30)
    assert stats.split_half(values.limit(0), (5,), 3, 30).collect() == []
    # Lengths that are written already are not computed again.
    folder, count = f"file://{tmp_path}/curve", []
    whole = stats.split_half
    monkeypatch.setattr(stats, "split_half", lambda v, of, *a, **k: count.append(list(of)) or whole(v, of, *a, **k))
    first = stats.reliability_curve(values, 3, 8, 12, 30, folder=folder, step=2, seed=2).collect()
    again = stats.reliability_curve(values, 3, 10, 12, 30, folder=folder, step=2, seed=2).collect()
    assert count == [[5, 6], [7], [8, 9]] and len(first) == 3 and len(again) == 5
    assert {row.l: row.reliability for row in again}[5] == pytest.approx(np.mean([got[5, k] for k in range(12)]))


def test_movie_frames_fill_the_whole(spark):
    df = spark.range(7).select(F.lit(1).alias("u"), F.col("id").alias("i"))
    assert [(r["first"], r["last"]) for r in grid.movie_frames(df, "i", ["u"], 24).orderBy("i").collect()] == [(3 * i, 3 * i + 2) for i in range(7)]
    assert [(r["first"], r["last"]) for r in grid.movie_frames(df, "i", ["u"], 4).orderBy("i").collect()] == [(i, i) for i in range(4)]
    assert align.BROADCAST > 0


def test_a_normal_of_zero_is_infinite(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (1.0, 0.25), (0.5, 0.0), (-1.0, 0.0), (None, 0.0)], "u double, v double")
    got = [x.n for x in rows.select(F.round(box_muller(F.col("u"), F.col("v")), 6).alias("n")).collect()]
    assert got == [math.inf, 0.0, round(math.sqrt(2 * math.log(2)), 6), None, None]
