"""The recurrent classifier against loops over single numbers."""

import math

import numpy as np
import pytest

from isoptic.operators import classifier


def weights(seed=0, channels=2, hidden=3, classes=3):
    r = np.random.default_rng(seed)
    w, inside = {}, 1
    norm = lambda name, n: {f"{name}.weight": r.normal(1, 0.1, n), f"{name}.bias": r.normal(0, 0.1, n), f"{name}.running_mean": r.normal(0, 0.1, n), f"{name}.running_var": r.uniform(0.5, 2, n)}
    for name in classifier.CONVOLUTIONS:
        w[f"conv_stack.{name}.0.weight"] = r.normal(size=(channels, inside, 2, 11))
        w |= norm(f"conv_stack.{name}.1", channels)
        inside = channels
    inside = channels * 4
    for name in classifier.RECURRENT:
        for end in ("", "_reverse"):
            w[f"rnn_stack.{name}.rnn.weight_ih_l0{end}"] = r.normal(size=(3 * hidden, inside))
            w[f"rnn_stack.{name}.rnn.weight_hh_l0{end}"] = r.normal(size=(3 * hidden, hidden))
        w |= norm(f"rnn_stack.{name}.batch_norm_op.module", hidden)
        inside = hidden
    return w | {"fc.0.module.weight": r.normal(size=(classes, hidden))}


def plain_convolution(x, k):
    o, c, rows, width = k.shape
    h, n = len(x[0]) + 2 * (rows // 2) - rows + 1, len(x[0][0])
    at = lambda ch, i, t: x[ch][i][t] if 0 <= i < len(x[0]) and 0 <= t < n else 0.0
    return [[[sum(k[a, ch, i, j] * at(ch, r - rows // 2 + i, t - width // 2 + j) for ch in range(c) for i in range(rows) for j in range(width)) for t in range(n)] for r in range(h)] for a in range(o)]


def plain_units(x, into, over):
    size, out = over.shape[1], []
    h = [0.0] * size
    gate = lambda v: 1 / (1 + math.exp(-v))
    for row in x:
        a, b = into @ np.array(row), over @ np.array(h)
        reset = [gate(a[k] + b[k]) for k in range(size)]
        keep = [gate(a[size + k] + b[size + k]) for k in range(size)]
        h = [(1 - keep[k]) * math.tanh(a[2 * size + k] + reset[k] * b[2 * size + k]) + keep[k] * h[k] for k in range(size)]
        out.append(h)
    return out


def plain(moves, w):
    norm = lambda v, name, k: (v - w[f"{name}.running_mean"][k]) / math.sqrt(w[f"{name}.running_var"][k] + 1e-5) * w[f"{name}.weight"][k] + w[f"{name}.bias"][k]
    x = [moves.tolist()]
    for name in classifier.CONVOLUTIONS:
        x = [[[min(max(norm(v, f"conv_stack.{name}.1", ch), 0.0), 20.0) for v in row] for row in rows] for ch, rows in enumerate(plain_convolution(x, w[f"conv_stack.{name}.0.weight"]))]
    x = [[x[ch][r][t] for ch in range(len(x)) for r in range(len(x[0]))] for t in range(len(x[0][0]))]
    for name in classifier.RECURRENT:
        p = f"rnn_stack.{name}.rnn.weight"
        ahead = plain_units(x, w[f"{p}_ih_l0"], w[f"{p}_hh_l0"])
        back = plain_units(x[::-1], w[f"{p}_ih_l0_reverse"], w[f"{p}_hh_l0_reverse"])[::-1]
        x = [[norm(a + b, f"rnn_stack.{name}.batch_norm_op.module", k) for k, (a, b) in enumerate(zip(u, v))] for u, v in zip(ahead, back)]
    return np.array(x) @ w["fc.0.module.weight"].T


def test_scores():
    w, r = weights(), np.random.default_rng(1)
    moves = r.normal(size=(2, 2, 17))
    got = classifier.class_scores(moves, w)
    for k in range(2):
        np.testing.assert_allclose(got[k], plain(moves[k], w), rtol=1e-9)
    x, y = r.normal(size=18), r.normal(size=18)
    codes = classifier.event_codes(x, y, w)
    assert codes[0] == 0 and codes[1:].tolist() == (plain(np.stack([np.diff(x), np.diff(y)]), w).argmax(axis=1) + 1).tolist()


def test_windows_and_weights(spark, tmp_path):
    w = weights()
    np.savez(tmp_path / "w.npz", **{f"module.{k}": v for k, v in w.items()})
    path = str(tmp_path / "w.npz")
    r = np.random.default_rng(2)
    rows = [(k, [(float(t), float(r.normal()), float(r.normal())) for t in range(20)]) for k in range(5)]
    df = spark.createDataFrame(rows, "window long, samples array<struct<t:double,x:double,y:double>>")
    got = classifier.classified(df, "window long", lambda: classifier.load_weights(path)).orderBy("window", "t").collect()
    want = [int(c) for _, s in rows for c in classifier.event_codes(np.array([p[1] for p in s]), np.array([p[2] for p in s]), w)]
    assert [g.evt for g in got] == want
    with pytest.raises(FileNotFoundError):
        classifier.load_weights(str(tmp_path / "none.npz"))


def test_windows_of_any_length_go_together(spark, monkeypatch):
    w, r = weights(), np.random.default_rng(5)
    rows = [(k, [(float(t), float(r.normal()), float(r.normal())) for t in range(n)]) for k, n in enumerate([20, 1, 7, 20, 0, 7, 20])]
    calls = []
    one = classifier.class_scores
    monkeypatch.setattr(classifier, "class_scores", lambda moves, w: calls.append(len(moves)) or one(moves, w))
    x = r.normal(size=(9, 2, 20))
    assert classifier.window_codes(x, w).tolist() == [classifier.event_codes(*v, w).tolist() for v in x]
    assert calls == [9] + [1] * 9
    monkeypatch.undo()
    df = spark.createDataFrame(rows, "window long, samples array<struct<t:double,x:double,y:double>>").coalesce(1)
    got = {(g.window, g.t): g.evt for g in classifier.classified(df, "window long", lambda: w).collect()}
    want = {(k, t): int(c) for k, s in rows for t, c in enumerate(classifier.event_codes(np.array([p[1] for p in s]), np.array([p[2] for p in s]), w))}
    assert got == want
