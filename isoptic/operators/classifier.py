"""Event codes of gaze windows by a recurrent classifier, in NumPy.

Two convolutions over both coordinates and time, recurrent layers whose two
directions are summed, and a linear layer. Weights are a mapping of arrays by
their names in a PyTorch state; what trains them is elsewhere.
"""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vector import score_sequences

Weights = Mapping[str, np.ndarray]
#: Activations of the convolutions are cut to this range.
LOW, HIGH = 0.0, 20.0
CONVOLUTIONS, RECURRENT = ("conv1", "conv2"), ("gru1", "gru2", "gru3")


def load_weights(path: str) -> dict[str, np.ndarray]:
    """Arrays of an NPZ file, without the prefix that parallel training adds. A
    file that is missing or no archive fails: a model is never run untrained."""
    if not zipfile.is_zipfile(path):
        raise FileNotFoundError(f"no weights at {path}")
    with np.load(path, allow_pickle=False) as found:
        return {k.removeprefix("module."): found[k] for k in found.files}


def seeded_weights(channels: int = 8, hidden: int = 64, classes: int = 3, rows: int = 2, width: int = 11, seed: int = 220617) -> dict[str, np.ndarray]:
    """Untrained weights, uniform within one over the root of a layer's inputs; all
    normalisations pass numbers on as they are."""
    r = np.random.default_rng(seed)
    inside, w = 1, {}

    def drawn(*shape: int) -> np.ndarray:
        return r.uniform(-1, 1, shape) / np.prod(shape[1:]) ** 0.5

    def norm(name: str, n: int) -> dict[str, np.ndarray]:
        return {f"{name}.weight": np.ones(n), f"{name}.bias": np.zeros(n), f"{name}.running_mean": np.zeros(n), f"{name}.running_var": np.ones(n)}

    for name in CONVOLUTIONS:
        w[f"conv_stack.{name}.0.weight"] = drawn(channels, inside, rows, width)
        w |= norm(f"conv_stack.{name}.1", channels)
        inside = channels
    inside = channels * (2 + len(CONVOLUTIONS))  # each convolution adds a row
    for name in RECURRENT:
        for end in ("", "_reverse"):
            w[f"rnn_stack.{name}.rnn.weight_ih_l0{end}"] = drawn(3 * hidden, inside)
            w[f"rnn_stack.{name}.rnn.weight_hh_l0{end}"] = drawn(3 * hidden, hidden)
        w |= norm(f"rnn_stack.{name}.batch_norm_op.module", hidden)
        inside = hidden
    return w | {"fc.0.module.weight": drawn(classes, hidden)}


def _normalised(x: np.ndarray, w: Weights, name: str, axis: int) -> np.ndarray:
    """Batch normalisation with the statistics of training."""
    shape = [-1 if k == axis else 1 for k in range(x.ndim)]
    part = {k: w[f"{name}.{k}"].reshape(shape) for k in ("running_mean", "running_var", "weight", "bias")}
    return (x - part["running_mean"]) / np.sqrt(part["running_var"] + 1e-5) * part["weight"] + part["bias"]


def _convolved(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """``x`` (window, channel, row, time) with zeros of half a kernel around."""
    _, _, rows, width = kernel.shape
    padded = np.pad(x, ((0, 0), (0, 0), (rows // 2,) * 2, (width // 2,) * 2))
    return np.einsum("bcijrt,ocrt->boij", sliding_window_view(padded, (rows, width), axis=(2, 3)), kernel, optimize=True)


def _gates(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _recurred(x: np.ndarray, into: np.ndarray, over: np.ndarray) -> np.ndarray:
    """Gated recurrent units over ``x`` (window, time, feature)."""
    size = over.shape[1]
    given, state, out = x @ into.T, np.zeros((len(x), size)), np.empty((*x.shape[:2], size))
    for t in range(x.shape[1]):
        held = state @ over.T
        reset, update = (_gates(given[:, t, k * size : (k + 1) * size] + held[:, k * size : (k + 1) * size]) for k in (0, 1))
        new = np.tanh(given[:, t, 2 * size :] + reset * held[:, 2 * size :])
        state = out[:, t] = (1 - update) * new + update * state
    return out


def class_scores(moves: np.ndarray, w: Weights) -> np.ndarray:
    """Scores (window, time, class) of ``moves`` (window, coordinate, time)."""
    x = moves[:, None].astype(np.float64)
    for name in CONVOLUTIONS:
        x = np.clip(_normalised(_convolved(x, w[f"conv_stack.{name}.0.weight"]), w, f"conv_stack.{name}.1", 1), LOW, HIGH)
    x = x.reshape(len(x), -1, x.shape[3]).transpose(0, 2, 1)
    for name in RECURRENT:
        into, over = (f"rnn_stack.{name}.rnn.weight_{k}_l0" for k in ("ih", "hh"))
        ahead = _recurred(x, w[into], w[over])
        back = _recurred(x[:, ::-1], w[f"{into}_reverse"], w[f"{over}_reverse"])[:, ::-1]
        x = _normalised(ahead + back, w, f"rnn_stack.{name}.batch_norm_op.module", 2)
    return x @ w["fc.0.module.weight"].T


#: Samples of windows that go through the model at a time, about.
SAMPLES = 8192


def window_codes(moves: np.ndarray, w: Weights) -> np.ndarray:
    """A code from 1 for each sample of windows of one length (window, coordinate, time)
    but the first, which has 0: the model sees the steps between samples."""
    out = np.zeros((len(moves), moves.shape[2]), np.int32)
    if moves.shape[2] > 1:
        out[:, 1:] = class_scores(np.diff(moves), w).argmax(axis=2) + 1
    return out


def event_codes(x: np.ndarray, y: np.ndarray, w: Weights) -> np.ndarray:
    """``window_codes`` of one window."""
    return window_codes(np.stack([x, y])[None], w)[0]


def classified(windows: DataFrame, keys: str, load: Callable[[], Weights]) -> DataFrame:
    """``t`` and ``evt`` of each sample of ``windows`` (the columns of the schema
    ``keys``, and ``samples`` of t, x, y). ``load`` gives the weights, once a task.
    Windows of a batch that are equally long go through the model together."""
    names = [k.split()[0] for k in keys.split(",")]

    def scorer() -> Callable[[pd.DataFrame], pd.DataFrame]:
        w = load()

        def score(batch: pd.DataFrame) -> pd.DataFrame:
            out = []
            size = batch["_t"].map(len).to_numpy(np.int64)
            for n in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == n)
                each = max(1, SAMPLES // n)
                for some in (at[k : k + each] for k in range(0, len(at), each)):
                    rows = batch.iloc[some]
                    t, x, y = (np.stack(rows[c].to_list()).astype(np.float64) for c in ("_t", "_x", "_y"))
                    codes = window_codes(np.stack([x, y], axis=1), w)
                    own = rows[names].iloc[np.repeat(np.arange(len(some)), n)]
                    out.append(own.assign(t=t.ravel(), evt=codes.ravel()))
            return pd.concat(out) if out else pd.DataFrame(columns=[*names, "t", "evt"])

        return score

    def of(c: str) -> Column:
        return F.transform("samples", lambda s: s[c].cast("double")).alias(f"_{c}")

    return score_sequences(windows.where("samples is not null").select(*names, *map(of, ("t", "x", "y"))), scorer, f"{keys}, t double, evt int")
