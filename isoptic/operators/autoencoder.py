"""Windows of gaze to latent vectors and back, in NumPy, with gradients.

Two convolutions over both coordinates and time, pooling by two, two bidirectional
recurrent layers and a linear layer give the latent vector of a window; a linear layer,
three transposed convolutions and a linear layer give the window back. Weights are arrays
by their names in a PyTorch state; all sizes follow from them.

Each layer gives its output and a function from the gradient of its output to that of its
input, which adds the gradients of its weights to a mapping on the way.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vector import score_sequences

Weights = Mapping[str, np.ndarray]
Gradients = dict[str, np.ndarray]
Layer = tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]
SLOPE, POOL = 0.1, 2


def initial(length: int = 200, latent: int = 64, channels: tuple[int, int] = (32, 64), hidden: tuple[int, int] = (64, 32), outward: tuple[int, int, int] = (32, 64, 128), width: int = 5, seed: int = 12231) -> dict[str, np.ndarray]:
    """Seeded weights, uniform within one over the root of a layer's inputs."""
    r = np.random.default_rng(seed)
    out: dict[str, np.ndarray] = {}

    def add(name: str, shape: tuple[int, ...], inputs: int, bias: int) -> None:
        out[f"{name}.weight"] = r.uniform(-1, 1, shape) / inputs**0.5
        out[f"{name}.bias"] = r.uniform(-1, 1, bias) / inputs**0.5

    add("encoder.conv1", (channels[0], 1, 2, width), 2 * width, channels[0])
    add("encoder.conv2", (channels[1], channels[0], 1, width), channels[0] * width, channels[1])
    inputs = channels[1]
    for name, size in zip(("encoder.bilstm1", "encoder.bilstm2"), hidden, strict=True):
        for way in ("", "_reverse"):
            for part, shape in (("weight_ih", (4 * size, inputs)), ("weight_hh", (4 * size, size)), ("bias_ih", (4 * size,)), ("bias_hh", (4 * size,))):
                out[f"{name}.{part}_l0{way}"] = r.uniform(-1, 1, shape) / size**0.5
        inputs = 2 * size
    add("encoder.fc_latent", (latent, inputs), inputs, latent)
    add("decoder.fc_decoder", (inputs, latent), latent, inputs)
    sizes = (inputs, *outward)
    for name, a, b in zip(("deconv_layer", "conv_final1", "conv_final2"), sizes[:-1], sizes[1:], strict=True):
        add(f"decoder.{name}", (a, b, 1, width), b * width, b)
    add("decoder.linear_final", (length, sizes[-1]), sizes[-1], length)
    return out


def _linear(x: np.ndarray, w: Weights, name: str, g: Gradients) -> Layer:
    kernel = w[f"{name}.weight"]

    def back(d: np.ndarray) -> np.ndarray:
        flat = d.reshape(-1, d.shape[-1])
        g[f"{name}.weight"] = flat.T @ x.reshape(-1, x.shape[-1])
        g[f"{name}.bias"] = flat.sum(axis=0)
        return d @ kernel

    return x @ kernel.T + w[f"{name}.bias"], back


def _windows(x: np.ndarray, width: int) -> np.ndarray:
    """(window, channel, time, tap), with zeros of half the taps around."""
    return sliding_window_view(np.pad(x, ((0, 0), (0, 0), (width // 2, width // 2))), width, axis=2)


def _convolved(x: np.ndarray, kernel: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    """``kernel`` (out, in, tap) over ``x`` (window, in, time); ``back`` gives the
    gradients of both."""
    seen = _windows(x, kernel.shape[2])

    def back(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = kernel[:, :, ::-1].transpose(1, 0, 2)
        return np.einsum("botk,iok->bit", _windows(d, kernel.shape[2]), turned, optimize=True), np.einsum("bot,bitk->oik", d, seen, optimize=True)

    return np.einsum("bitk,oik->bot", seen, kernel, optimize=True), back


def _convolution(x: np.ndarray, w: Weights, name: str, g: Gradients, transposed: bool = False) -> Layer:
    """A kernel of PyTorch's shape: (out, in, row, tap), or (in, out, 1, tap) where it is
    ``transposed``, which is the same turned round."""
    given = w[f"{name}.weight"]
    kernel = given[:, :, 0, ::-1].transpose(1, 0, 2) if transposed else given.reshape(len(given), -1, given.shape[3])
    y, through = _convolved(x, kernel)

    def back(d: np.ndarray) -> np.ndarray:
        dx, dk = through(d)
        g[f"{name}.weight"] = dk.transpose(1, 0, 2)[:, :, None, ::-1] if transposed else dk.reshape(given.shape)
        g[f"{name}.bias"] = d.sum(axis=(0, 2))
        return dx

    return y + w[f"{name}.bias"][:, None], back


def _leaky(x: np.ndarray) -> Layer:
    slope = np.where(x > 0, 1.0, SLOPE)
    return x * slope, lambda d: d * slope


def _pooled(x: np.ndarray) -> Layer:
    """The larger of two neighbours in time; a last one without another goes."""
    b, c, n = x.shape
    pairs = x[:, :, : n // POOL * POOL].reshape(b, c, n // POOL, POOL)
    best = pairs.argmax(axis=3)[..., None]

    def back(d: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        spread = np.zeros_like(pairs)
        np.put_along_axis(spread, best, d[..., None], axis=3)
        out[:, :, : n // POOL * POOL] = spread.reshape(b, c, -1)
        return out

    return np.take_along_axis(pairs, best, axis=3)[..., 0], back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lstm(x: np.ndarray, w: Weights, name: str, way: str, g: Gradients) -> Layer:
    """A long short-term memory over ``x`` (window, time, feature): input, forget,
    candidate and output gates."""
    into, over = w[f"{name}.weight_ih_l0{way}"], w[f"{name}.weight_hh_l0{way}"]
    b, n, _ = x.shape
    size = over.shape[1]
    given = x @ into.T + w[f"{name}.bias_ih_l0{way}"] + w[f"{name}.bias_hh_l0{way}"]
    h, c = np.zeros((n + 1, b, size)), np.zeros((n + 1, b, size))
    gates = np.empty((n, b, 4 * size))
    for t in range(n):
        z = given[:, t] + h[t] @ over.T
        z[:, : 2 * size], z[:, 2 * size : 3 * size], z[:, 3 * size :] = _sigmoid(z[:, : 2 * size]), np.tanh(z[:, 2 * size : 3 * size]), _sigmoid(z[:, 3 * size :])
        i, f, new, o = (z[:, k * size : (k + 1) * size] for k in range(4))
        c[t + 1] = f * c[t] + i * new
        h[t + 1] = o * np.tanh(c[t + 1])
        gates[t] = z

    def back(d: np.ndarray) -> np.ndarray:
        dz = np.empty_like(gates)
        dh, dc = np.zeros((b, size)), np.zeros((b, size))
        for t in range(n - 1, -1, -1):
            i, f, new, o = (gates[t, :, k * size : (k + 1) * size] for k in range(4))
            dh = dh + d[:, t]
            squashed = np.tanh(c[t + 1])
            dc = dc + dh * o * (1 - squashed**2)
            parts = dc * new * i * (1 - i), dc * c[t] * f * (1 - f), dc * i * (1 - new**2), dh * squashed * o * (1 - o)
            dz[t] = np.concatenate(parts, axis=1)
            dh, dc = dz[t] @ over, dc * f
        flat = dz.reshape(n * b, -1)
        g[f"{name}.weight_ih_l0{way}"] = flat.T @ x.transpose(1, 0, 2).reshape(n * b, -1)
        g[f"{name}.weight_hh_l0{way}"] = flat.T @ h[:-1].reshape(n * b, -1)
        g[f"{name}.bias_ih_l0{way}"] = g[f"{name}.bias_hh_l0{way}"] = flat.sum(axis=0)
        return (dz @ into).transpose(1, 0, 2)

    return h[1:].transpose(1, 0, 2), back


def _both_ways(x: np.ndarray, w: Weights, name: str, g: Gradients) -> Layer:
    ahead, first = _lstm(x, w, name, "", g)
    behind, second = _lstm(x[:, ::-1], w, name, "_reverse", g)
    size = ahead.shape[2]
    return np.concatenate([ahead, behind[:, ::-1]], axis=2), lambda d: first(d[..., :size]) + second(d[:, ::-1, size:])[:, ::-1]


def _encoded(x: np.ndarray, w: Weights, g: Gradients) -> Layer:
    steps: list[Callable[[np.ndarray], np.ndarray]] = []

    def then(layer: Layer) -> np.ndarray:
        steps.append(layer[1])
        return layer[0]

    for name in ("encoder.conv1", "encoder.conv2"):
        x = then(_leaky(then(_convolution(x, w, name, g))))
    x = then(_pooled(x))
    x = then((x.transpose(0, 2, 1), lambda d: d.transpose(0, 2, 1)))
    for name in ("encoder.bilstm1", "encoder.bilstm2"):
        x = then(_both_ways(x, w, name, g))
    shape = x.shape

    def from_last(d: np.ndarray) -> np.ndarray:
        out = np.zeros(shape)
        out[:, -1] = d
        return out

    x = then((x[:, -1], from_last))
    return then(_linear(x, w, "encoder.fc_latent", g)), lambda d: _back(steps, d)


def _decoded(z: np.ndarray, w: Weights, g: Gradients) -> Layer:
    x, first = _linear(z, w, "decoder.fc_decoder", g)
    x = np.repeat(x[:, :, None], 2, axis=2)  # one row for each coordinate
    steps = [first, lambda d: d.sum(axis=2)]
    for name in ("decoder.deconv_layer", "decoder.conv_final1", "decoder.conv_final2"):
        x, back = _convolution(x, w, name, g, transposed=True)
        steps.append(back)
    x, last = _linear(x.transpose(0, 2, 1), w, "decoder.linear_final", g)
    return x, lambda d: _back([*steps, lambda e: e.transpose(0, 2, 1)], last(d))


def _back(steps: list[Callable[[np.ndarray], np.ndarray]], d: np.ndarray) -> np.ndarray:
    for step in reversed(steps):
        d = step(d)
    return d


def encode(x: np.ndarray, w: Weights) -> np.ndarray:
    """Latent vectors (window, latent) of ``x`` (window, coordinate, time)."""
    return _encoded(x, w, {})[0]


def decode(z: np.ndarray, w: Weights) -> np.ndarray:
    """Windows (window, coordinate, time) of latent vectors."""
    return _decoded(z, w, {})[0]


def squared_error(x: np.ndarray, w: Weights) -> tuple[float, int]:
    """The sum of squared differences between windows and what comes back, and of how
    many numbers."""
    return float(((decode(encode(x, w), w) - x) ** 2).sum()), x.size


def gradient(x: np.ndarray, w: Weights) -> tuple[float, int, Gradients]:
    """``squared_error`` with the gradient of its sum."""
    g: Gradients = {}
    z, into = _encoded(x, w, g)
    y, out = _decoded(z, w, g)
    into(out(2 * (y - x)))
    return float(((y - x) ** 2).sum()), x.size, g


def flat_window(samples: Column, *cols: str) -> Column:
    """The columns of an array of samples, one after the other, as one array."""

    def of(name: str) -> Column:
        return F.transform(samples, lambda s: s[name].cast("double"))

    return F.concat(*map(of, cols))


def reconstructed(windows: DataFrame, keys: list[str], load: Callable[[], Weights], vector: str = "x", coordinates: int = 2) -> DataFrame:
    """``keys``, the ``latent`` vector and the mean squared ``error`` of each window, a
    ``vector`` of its coordinates one after the other. A window with another length than
    the weights have, or a null in it, has null for both. ``load`` gives the weights, once
    a task."""
    kinds = ", ".join(f"`{k}` {windows.schema[k].dataType.simpleString()}" for k in keys)

    def scorer() -> Callable[[pd.DataFrame], pd.DataFrame]:
        w = load()
        size = coordinates * len(w["decoder.linear_final.bias"])

        def score(batch: pd.DataFrame) -> pd.DataFrame:
            out = batch[keys].copy()
            ok = [v is not None and len(v) == size and not pd.isna(v).any() for v in batch[vector]]
            latent, error = [None] * len(batch), np.full(len(batch), np.nan, object)
            error[:] = None
            at = np.flatnonzero(ok)
            for k in range(0, len(at), 256):
                some = at[k : k + 256]
                x = np.stack([np.asarray(v, np.float64) for v in batch[vector].iloc[some]]).reshape(len(some), coordinates, -1)
                z = encode(x, w)
                mse = ((decode(z, w) - x) ** 2).mean(axis=(1, 2))
                for j, i in enumerate(some):
                    latent[i], error[i] = z[j], mse[j]
            return out.assign(latent=latent, error=error)

        return score

    return score_sequences(windows.select(*keys, vector), scorer, f"{kinds}, latent array<double>, error double")
