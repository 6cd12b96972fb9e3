import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoptic.operators import autoencoder as A
from isoptic.operators import sequence, training

SMALL = {"length": 8, "latent": 3, "channels": (2, 4), "hidden": (3, 2), "outward": (3, 2, 5)}


def sig(x):
    return 1 / (1 + math.exp(-x))


def plain(x, w):
    """One window (coordinate, time) by loops: its latent vector and what comes back."""
    n = x.shape[1]

    def conv(rows, kernel, bias):  # rows: [channel][time]
        return [[bias[o] + sum(kernel[o][c][k] * rows[c][t + k - 2] for c in range(len(rows)) for k in range(5) if 0 <= t + k - 2 < len(rows[0])) for t in range(len(rows[0]))] for o in range(len(kernel))]

    leaky = lambda rows: [[v if v > 0 else 0.1 * v for v in row] for row in rows]
    k1 = w["encoder.conv1.weight"][:, 0]
    h = leaky(conv(x.tolist(), k1, w["encoder.conv1.bias"]))
    h = leaky(conv(h, w["encoder.conv2.weight"][:, :, 0], w["encoder.conv2.bias"]))
    h = [[max(row[2 * t], row[2 * t + 1]) for t in range(n // 2)] for row in h]
    seq = [[row[t] for row in h] for t in range(n // 2)]

    def lstm(seq, name, way):
        into, over, b = w[f"{name}.weight_ih_l0{way}"], w[f"{name}.weight_hh_l0{way}"], w[f"{name}.bias_ih_l0{way}"] + w[f"{name}.bias_hh_l0{way}"]
        size = over.shape[1]
        hid, cell, out = [0.0] * size, [0.0] * size, []
        for v in seq:
            z = [b[j] + sum(into[j][k] * v[k] for k in range(len(v))) + sum(over[j][k] * hid[k] for k in range(size)) for j in range(4 * size)]
            cell = [sig(z[size + j]) * cell[j] + sig(z[j]) * math.tanh(z[2 * size + j]) for j in range(size)]
            hid = [sig(z[3 * size + j]) * math.tanh(cell[j]) for j in range(size)]
            out.append(hid)
        return out

    for name in ("encoder.bilstm1", "encoder.bilstm2"):
        a, b = lstm(seq, name, ""), lstm(seq[::-1], name, "_reverse")[::-1]
        seq = [p + q for p, q in zip(a, b, strict=True)]
    latent = w["encoder.fc_latent.weight"] @ np.array(seq[-1]) + w["encoder.fc_latent.bias"]
    y = w["decoder.fc_decoder.weight"] @ latent + w["decoder.fc_decoder.bias"]
    h = [[v, v] for v in y]
    for name in ("deconv_layer", "conv_final1", "conv_final2"):  # transposed: each input adds to five outputs
        kernel, bias = w[f"decoder.{name}.weight"][:, :, 0], w[f"decoder.{name}.bias"]
        out = [[bias[o]] * 2 for o in range(kernel.shape[1])]
        for i, row in enumerate(h):
            for s, v in enumerate(row):
                for o in range(kernel.shape[1]):
                    for k in range(5):
                        if 0 <= s + k - 2 < 2:
                            out[o][s + k - 2] += v * kernel[i][o][k]
        h = out
    back = np.array(h).T @ w["decoder.linear_final.weight"].T + w["decoder.linear_final.bias"]
    return latent, back


@pytest.fixture(scope="module")
def weights():
    return A.initial(**SMALL, seed=1)


def test_windows_go_to_latent_vectors_and_back_as_by_loops(weights):
    x = np.random.default_rng(0).normal(size=(4, 2, 8))
    z = A.encode(x, weights)
    y = A.decode(z, weights)
    for i in range(4):
        latent, back = plain(x[i], weights)
        assert np.allclose(z[i], latent) and np.allclose(y[i], back)


def test_sizes_are_those_of_the_reference_state():
    w = A.initial()
    assert A.encode(np.zeros((1, 2, 200)), w).shape == (1, 64) and A.decode(np.zeros((1, 64)), w).shape == (1, 2, 200)
    assert w["encoder.bilstm2.weight_ih_l0_reverse"].shape == (128, 128) and w["decoder.conv_final2.weight"].shape == (64, 128, 1, 5)
    assert A.encode(np.zeros((0, 2, 200)), w).shape == (0, 64)


def test_gradients_are_those_of_small_differences(weights):
    x = np.random.default_rng(2).normal(size=(3, 2, 8))
    loss, n, g = A.gradient(x, weights)
    assert (loss, n) == (pytest.approx(A.squared_error(x, weights)[0]), 48)
    assert set(g) == set(weights)
    r = np.random.default_rng(3)
    for k, w in weights.items():
        assert g[k].shape == w.shape
        for _ in range(3):
            at = tuple(r.integers(0, s) for s in w.shape)
            up, down = dict(weights), dict(weights)
            up[k], down[k] = w.copy(), w.copy()
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            by = (A.squared_error(x, up)[0] - A.squared_error(x, down)[0]) / 2e-5
            assert g[k][at] == pytest.approx(by, rel=1e-4, abs=1e-6), (k, at)


def table(spark, n=37, seed=5, length=8):
    r = np.random.default_rng(seed)
    t = np.arange(length)
    x = np.stack([np.stack([np.sin(t / 3 + a), np.cos(t / 4 + b)]) for a, b in r.uniform(0, 6, (n, 2))])
    return x, spark.createDataFrame([(i, [float(v) for v in one.ravel()]) for i, one in enumerate(x)], "id long, x array<double>")


def options(tmp_path, **over):
    return {"ids": ["id"], "vector": "x", "shape": (2, 8), "gradient": A.gradient, "loss": A.squared_error, "folder": f"file://{tmp_path}/batches"} | over


def test_training_is_that_of_one_loop(spark, tmp_path, weights):
    x, df = table(spark)
    got = training.train(df, weights=weights, epochs=3, batch=10, every=2, rate=0.01, each=4, seed=9, **options(tmp_path))
    batches = {r.id: r.batch for r in sequence.seeded_batches(df, ["id"], 10, 9).collect()}
    w, m, v, steps, order, losses, scores = dict(weights), {}, {}, 0, np.random.default_rng(9), [], {}
    for epoch in range(3):
        total = 0.0
        for b in order.permutation(4):
            rows = x[[i for i in range(37) if batches[i] == b]]
            loss, n, g = A.gradient(rows, w)
            steps += 1
            for k in w:
                d = 100 * g[k] / n
                m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                v[k] = 0.999 * v.get(k, 0) + 0.001 * d * d
                w[k] = w[k] - 0.01 * (m[k] / (1 - 0.9**steps)) / (np.sqrt(v[k] / (1 - 0.999**steps)) + 1e-8)
            total += 100 * loss / n
        losses.append(total / 4)
        scores[epoch] = 100 * A.squared_error(x, w)[0] / x.size
    assert got.losses == pytest.approx(losses) and got.skipped == 0
    assert got.scores == pytest.approx({k: scores[k] for k in (1, 2)})
    for k in w:
        assert np.allclose(got.weights[k], w[k], atol=1e-9)
    assert got.best_score == min(got.scores.values())


def test_the_loss_falls_and_the_best_state_is_kept(spark, tmp_path, weights):
    _, df = table(spark, 24)
    got = training.train(df, weights=weights, epochs=12, batch=24, every=3, rate=0.02, **options(tmp_path))
    assert got.losses[-1] < 0.9 * got.losses[0]
    assert got.best_score == min(got.scores.values()) and list(got.scores) == [2, 5, 8, 11]


def test_steps_that_are_not_finite_are_left_out(spark, tmp_path, weights):
    _, df = table(spark, 8)

    def broken(x, w):
        return math.nan, x.size, {k: np.zeros_like(v) for k, v in w.items()}

    got = training.train(df, weights=weights, epochs=2, batch=4, **options(tmp_path, gradient=broken))
    assert got.skipped == 4 and all((got.weights[k] == weights[k]).all() for k in weights)


def test_rows_that_cannot_be_used_and_empty_tables(spark, tmp_path, weights):
    _, df = table(spark, 6)
    bad = spark.createDataFrame([(100, None), (101, [1.0]), (102, [None] * 16), (103, [math.nan] * 16), (104, [math.inf] * 16)], "id long, x array<double>")
    both = training.train(df.unionByName(bad), weights=weights, epochs=1, batch=64, **options(tmp_path))
    alone = training.train(df, weights=weights, epochs=1, batch=64, **options(tmp_path, folder=f"file://{tmp_path}/alone"))
    assert all(np.allclose(both.weights[k], alone.weights[k]) for k in weights)
    none = training.train(bad, weights=weights, epochs=1, **options(tmp_path, folder=f"file://{tmp_path}/none"))
    assert none.losses == [] and none.weights["encoder.conv1.bias"] is weights["encoder.conv1.bias"]


def test_sums_meet_in_a_tree_and_tasks_follow_the_batch(spark, weights):
    x, df = table(spark, 40)
    loss, n, g = training.summed_gradient(df.repartition(20), "x", (2, 8), weights, A.gradient, each=3, fan_in=3)
    want = A.gradient(x, weights)
    assert (loss, n) == (pytest.approx(want[0]), want[1])
    assert all(np.allclose(g[k], want[2][k]) for k in weights)


def test_batches_are_whole_but_the_last_and_in_the_order_of_a_seeded_sort(spark):
    df = spark.range(10_007).withColumn("other", F.lit("x")).repartition(7)
    got = sequence.seeded_batches(df, ["id"], 64, 3).collect()
    sizes = {}
    for r in got:
        sizes[r.batch] = sizes.get(r.batch, 0) + 1
    assert len(got) == 10_007 and sizes == {b: 64 for b in range(156)} | {156: 10_007 - 156 * 64}
    order = [r.id for r in df.orderBy(F.xxhash64("id", F.lit(3)), "id").collect()]
    assert {r.id: r.batch for r in got} == {i: k // 64 for k, i in enumerate(order)}
    again = sequence.seeded_batches(df.repartition(3), ["id"], 64, 3).collect()
    assert sorted((r.id, r.batch) for r in again) == sorted((r.id, r.batch) for r in got)
    other = sequence.seeded_batches(df, ["id"], 64, 4)
    assert other.join(spark.createDataFrame(got).select("id", F.col("batch").alias("b")), "id").where("b <> batch").count() > 9000
    assert sequence.seeded_batches(df.limit(0), ["id"], 64).collect() == []


def test_windows_are_scored_in_batches(spark, weights):
    x, df = table(spark, 10)
    bad = spark.createDataFrame([(100, None), (101, [1.0])], "id long, x array<double>")
    got = {r.id: r for r in A.reconstructed(df.unionByName(bad), ["id"], lambda: weights).collect()}
    assert got[100].latent is None and got[101].error is None
    for i in range(10):
        latent, back = plain(x[i], weights)
        assert np.allclose(got[i].latent, latent) and got[i].error == pytest.approx(((back - x[i]) ** 2).mean())


def test_the_driver_gets_one_gradient(spark, weights, monkeypatch):
    x, df = table(spark, 40)
    rows = df.repartition(5)
    kind, sizes = type(rows), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: sizes.append(got := collect(self)) or got)
    loss, n, _ = training.summed_gradient(rows, "x", (2, 8), weights, A.gradient, each=3)
    assert [len(s) for s in sizes] == [1]
    assert (loss, n) == (pytest.approx(A.gradient(x, weights)[0]), x.size)
