"""Synchronous training of a model whose gradients add up.

A step takes the rows of one batch. Its tasks hold the weights by broadcast, each sums the
gradients of its rows, and those sums are added in a tree, so that the driver gets one
array of the model's size however many tasks there are. It takes one step of Adam and
sends the weights out again. A task's rows follow ``each`` and a step's the batch, never
the table.

Batches are dealt once, by a seeded order of all rows, and written to the shared folder by
batch, so a step reads the files of one; each epoch takes them in another order. Lost
executors repeat their part of one step.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequence import seeded_batches

Weights = Mapping[str, np.ndarray]
#: The sum of a loss over rows, of how many numbers it is, and the gradient of that sum.
Gradient = Callable[[np.ndarray, Weights], tuple[float, int, dict[str, np.ndarray]]]
Loss = Callable[[np.ndarray, Weights], tuple[float, int]]
SCHEMA = "loss double, numbers long, gradient binary"


@dataclass
class Trained:
    """``weights`` at the end and ``best`` (by validation) with its score; the mean loss of
    each epoch, the score of each epoch that was validated, and how many steps were left
    out as not finite."""

    weights: dict[str, np.ndarray]
    best: dict[str, np.ndarray]
    best_score: float = math.inf
    losses: list[float] = field(default_factory=list)
    scores: dict[int, float] = field(default_factory=dict)
    skipped: int = 0


class Adam:
    """Steps by the moments of gradients."""

    def __init__(self, rate: float = 0.001, first: float = 0.9, second: float = 0.999, small: float = 1e-8) -> None:
        self.rate, self.first, self.second, self.small, self.steps = rate, first, second, small, 0
        self.mean: dict[str, np.ndarray] = {}
        self.square: dict[str, np.ndarray] = {}

    def step(self, weights: Weights, gradient: Weights) -> dict[str, np.ndarray]:
        self.steps += 1
        out = {}
        for k, w in weights.items():
            d = gradient[k]
            self.mean[k] = self.first * self.mean.get(k, 0.0) + (1 - self.first) * d
            self.square[k] = self.second * self.square.get(k, 0.0) + (1 - self.second) * d * d
            mean, square = self.mean[k] / (1 - self.first**self.steps), self.square[k] / (1 - self.second**self.steps)
            out[k] = w - self.rate * mean / (np.sqrt(square) + self.small)
        return out


def _flat(parts: Weights, names: list[str]) -> np.ndarray:
    return np.concatenate([np.ravel(parts[k]) for k in names])


def _arrays(batches: Iterator[pa.RecordBatch], shape: tuple[int, ...], each: int) -> Iterator[np.ndarray]:
    """The vectors of a task's rows, ``each`` at a time."""
    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, *shape)
        for k in range(0, len(x), each):
            yield x[k : k + each]


def _summed(parts: Iterator[tuple[float, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    loss, numbers, total = 0.0, 0, None
    for one, n, d in parts:
        loss, numbers, total = loss + one, numbers + n, d.copy() if total is None else total + d
    if total is not None:
        yield pa.record_batch([pa.array([loss]), pa.array([numbers]), pa.array([total.tobytes()], pa.binary())], names=["loss", "numbers", "gradient"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[float, int, np.ndarray]]:
    for batch in batches:
        for loss, n, d in zip(*(batch.column(c).to_pylist() for c in ("loss", "numbers", "gradient")), strict=True):
            yield loss, n, np.frombuffer(d)


def summed_gradient(rows: DataFrame, vector: str, shape: tuple[int, ...], weights: Weights, gradient: Gradient, each: int = 64, fan_in: int = 16) -> tuple[float, int, dict[str, np.ndarray]]:
    """The loss, count and gradient of all ``rows``, summed by task and then in a tree of
    ``fan_in`` branches. ``each`` rows are computed at a time."""
    names = list(weights)
    sent = rows.sparkSession.sparkContext.broadcast(dict(weights))

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = (gradient(x, sent.value) for x in _arrays(batches, shape, each))
        yield from _summed((loss, n, _flat(d, names)) for loss, n, d in got)

    parts = rows.select(vector).mapInArrow(of_rows, SCHEMA)
    tasks = rows.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // fan_in)
        parts = parts.repartition(tasks).mapInArrow(lambda batches: _summed(_sums(batches)), SCHEMA)
    loss, numbers, total = 0.0, 0, np.zeros(sum(w.size for w in weights.values()))
    for r in parts.collect():  # one array, or none
        loss, numbers, total = loss + r.loss, numbers + r.numbers, total + np.frombuffer(r.gradient)
    sent.destroy()
    cut = np.cumsum([w.size for w in weights.values()])[:-1]
    return loss, numbers, {k: d.reshape(weights[k].shape) for k, d in zip(names, np.split(total, cut), strict=True)}


def mean_loss(rows: DataFrame, vector: str, shape: tuple[int, ...], weights: Weights, loss: Loss, each: int = 64) -> float:
    """Of all ``rows``; NaN of none."""
    sent = rows.sparkSession.sparkContext.broadcast(dict(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _arrays(batches, shape, each):
            one, n = loss(x, sent.value)
            yield pa.record_batch([pa.array([one]), pa.array([n])], names=["loss", "numbers"])

    got = rows.select(vector).mapInArrow(run, "loss double, numbers long").agg(F.sum("loss"), F.sum("numbers")).first()
    sent.destroy()
    return got[0] / got[1] if got[1] else math.nan


def train(
    rows: DataFrame,
    ids: list[str],
    vector: str,
    shape: tuple[int, ...],
    weights: Weights,
    gradient: Gradient,
    loss: Loss,
    folder: str,
    validation: DataFrame | None = None,
    epochs: int = 500,
    batch: int = 64,
    scale: float = 100.0,
    rate: float = 0.001,
    every: int = 10,
    seed: int = 0,
    each: int = 64,
) -> Trained:
    """Train on the ``vector`` of all ``rows``, each of the size of ``shape``.

    What is lowered is ``scale`` times the mean loss. A step whose loss or gradient is not
    finite is counted and left out. After every ``every`` epochs and the last one the mean
    loss of ``validation`` (the rows themselves, if there is none) is taken, and the
    weights with the smallest so far are kept. ``ids`` name a row, so that batches are the
    same in every run. ``folder`` is one that driver and executors share, and is written.
    Rows with a null vector, one of another size or with a null or non-finite number are
    left out. Without rows the weights stay as they are.
    """
    spark = rows.sparkSession
    size = math.prod(shape)
    usable = F.coalesce((F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    rows = rows.where(usable)
    dealt = seeded_batches(rows.select(*ids, vector), ids, batch, seed)
    parts = -(-batch // each)
    part = F.pmod(F.xxhash64(*ids), F.lit(parts))
    dealt.select("batch", vector, part.alias("_part")).repartition("batch", "_part").drop("_part").write.mode("overwrite").partitionBy("batch").parquet(folder)
    held = spark.read.schema(f"`{vector}` array<double>, batch long").parquet(folder)
    last = dealt.agg(F.max("batch")).first()[0]
    count = 0 if last is None else last + 1
    checked = held if validation is None else validation.where(usable)
    out = Trained(dict(weights), dict(weights))
    adam, order = Adam(rate), np.random.default_rng(seed)
    for epoch in range(epochs if count else 0):
        total = 0.0
        for number in order.permutation(count).tolist():
            one, n, d = summed_gradient(held.where(F.col("batch") == number), vector, shape, out.weights, gradient, each)
            value = scale * one / n
            if not math.isfinite(value) or not all(np.isfinite(x).all() for x in d.values()):
                out.skipped += 1
                continue
            out.weights = adam.step(out.weights, {k: x * (scale / n) for k, x in d.items()})
            total += value
        out.losses.append(total / count)
        if (epoch + 1) % every == 0 or epoch == epochs - 1:
            score = scale * mean_loss(checked, vector, shape, out.weights, loss, each)
            out.scores[epoch] = score
            if score < out.best_score:
                out.best, out.best_score = dict(out.weights), score
    return out
