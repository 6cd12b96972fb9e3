"""Clustering around centroids with Hamerly's bounds, in exact integers.

Each vector keeps an upper bound of the distance to its own centroid and one lower
bound of that to any other. After a round both are loosened by how far centroids have
moved. While the upper bound stays below the lower one, or below half the way from its
centroid to the next, the vector is where it was and isn't compared. Otherwise its own
distance is taken anew, and if that doesn't settle it, it is scanned against all
centroids in integers, the smaller number winning a tie. Bounds are rounded outwards, so
they skip a vector only where it is certain.

A round is one pass: rows with their bounds are written to the shared folder and read by
the next. Sums by centroid change by the vectors that have moved alone; the scan is asked
for those. The driver holds the centroids, k rows, and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .store import discard, keep

#: Components of a vector, steps of a component's unit, centroids, rounds.
SIZE, SCALE, K, ROUNDS = 64, 1024, 8, 10
#: Integers up to this have squared distances that a long holds, of up to 64 components.
MOST = 1 << 27
#: What bounds are widened by, as a part of them: more than their rounding.
WIDE = 1e-12
STATE = "id {id}, v binary, cluster int, was int, upper double, lower double, scanned boolean"


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vector: Column, size: int = SIZE) -> Column:
    """Whether a vector has ``size`` components, none null or without a finite value."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == size) & ~bad, F.lit(False))


def start_order(id_: Column, seed: int = 3) -> Column:
    """The order in which vectors become the first centroids."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")).cast("binary"), 256)


@dataclass
class Model:
    """``centroids`` (k, size), and the sums and counts that they come of."""

    centroids: np.ndarray
    sums: np.ndarray
    counts: np.ndarray


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    """Rows of integers; a vector is held as 32-bit integers, one after the other."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]
    return data.view("<i4").reshape(len(column), size).astype(np.int64)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (row, centroid)."""
    out = np.empty((len(v), len(c)), np.int64)
    for k, one in enumerate(c):
        d = v - one
        out[:, k] = np.einsum("ij,ij->i", d, d)
    return out


def _scanned(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid (of several the first), how far it is at most, and how far
    any other is at least."""
    d = squared(v, c)
    best = d.argmin(axis=1)
    upper = np.sqrt(d[np.arange(len(v)), best].astype(np.float64)) * (1 + WIDE)
    d[np.arange(len(v)), best] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(axis=1, initial=np.iinfo(np.int64).max).astype(np.float64)) * (1 - WIDE)
    return best, upper, np.where(len(c) > 1, lower, np.inf)


def hamerly(v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One round's ``own``, ``upper`` and ``lower``, and which rows were scanned, when
    centroids have moved from ``old`` to ``new``."""
    drift = np.sqrt(np.einsum("ij,ij->i", new - old, new - old).astype(np.float64)) * (1 + WIDE)
    between = np.sqrt(squared(new, new).astype(np.float64)) * (1 - WIDE)
    np.fill_diagonal(between, np.inf)
    far = np.argsort(-drift, kind="stable")
    second = drift[far[1]] if len(drift) > 1 else 0.0
    upper = (upper + drift[own]) * (1 + WIDE)
    lower = (lower - np.where(own == far[0], second, drift[far[0]])) * (1 - WIDE)
    sure = np.maximum(lower, between.min(axis=1, initial=np.inf)[own] / 2)
    at = np.flatnonzero(~(upper < sure))
    d = v[at] - new[own[at]]
    upper[at] = np.sqrt(np.einsum("ij,ij->i", d, d).astype(np.float64)) * (1 + WIDE)
    at = at[~(upper[at] < sure[at])]
    own, scanned = own.copy(), np.zeros(len(v), bool)
    scanned[at] = True
    if len(at):
        own[at], upper[at], lower[at] = _scanned(v[at], new)
    return own, upper, lower, scanned


def _round(old: np.ndarray | None, new: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _vectors(batch.column("v"), new.shape[1])
            if old is None:
                was = np.full(len(v), -1)
                own, upper, lower = _scanned(v, new)
                scanned = np.ones(len(v), bool)
            else:
                was = batch.column("cluster").to_numpy().astype(np.int64)
                # Bounds are changed in place, and Arrow's arrays aren't to be written.
                bounds = (batch.column(c).to_numpy().copy() for c in ("upper", "lower"))
                own, upper, lower, scanned = hamerly(v, was, *bounds, old, new)
            yield pa.record_batch(
                [batch.column("id"), batch.column("v"), *(pa.array(x.astype(np.int32)) for x in (own, was)), pa.array(upper), pa.array(lower), pa.array(scanned)],
                names=["id", "v", "cluster", "was", "upper", "lower", "scanned"],
            )

    return tokens.tidy(run)


def _changes(k: int, size: int):
    """A task's changes of sums and counts: a row for each centroid that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v = _vectors(batch.column("v"), size) if batch.num_rows else np.zeros((0, size), np.int64)
            for column, sign in (("cluster", 1), ("was", -1)):
                c = batch.column(column).to_numpy()
                for one in range(k):
                    of = c == one
                    sums[one] += sign * v[of].sum(axis=0)
                    counts[one] += sign * int(of.sum())
        some = np.flatnonzero(counts.astype(bool) | sums.any(axis=1))
        yield pa.record_batch([pa.array(some), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["c", "n", "s"])

    return run


def fit(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = 3) -> tuple[Model, DataFrame]:
    """The model and ``id``, ``v``, ``cluster`` of each usable vector, as assigned to
    the last centroids.

    Vectors of another size, a null one, and those with a component that is null, NaN
    or infinite are left out. The k with the smallest hash of their id start (of
    vectors with one id, as null ids all have, the smallest in integers; null ids come
    last); fewer vectors make fewer centroids, none an empty result. An empty cluster
    keeps its centroid; of equal distances the smaller number wins. Components that
    times ``scale`` exceed 2^27 fail, as distances would not be exact. Rows that repeat
    an id count one by one. Other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x")).where(usable(F.col("x"), size))
    exact = F.forall("x", lambda x: F.abs(x.cast("double") * F.lit(float(scale))) <= MOST)
    rows = rows.select("id", F.when(exact, integers(F.col("x"), scale)).otherwise(F.raise_error(F.lit(f"a component times {scale} is over {MOST}"))).alias("x"))
    first = rows.select("x", start_order(F.col("id"), seed).alias("h")).orderBy(F.col("h").asc_nulls_last(), "x").limit(k)
    new = np.array([r.x for r in first.select("x").collect()], np.int64).reshape(-1, size)
    schema = STATE.format(id=rows.schema["id"].dataType.simpleString())
    model = Model(new, np.zeros((len(new), size), np.int64), np.zeros(len(new), np.int64))
    if not len(new):
        return model, spark.createDataFrame([], schema)
    state, old = rows.mapInArrow(_packed, f"id {rows.schema['id'].dataType.simpleString()}, v binary"), None
    for left in range(rounds, -1, -1):
        moved = keep(state.mapInArrow(_round(old, model.centroids), schema), "centroids")
        if old is not None:
            discard(state)
        state = moved
        if not left:
            break
        changed = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(_changes(len(new), size), "c long, n long, s array<long>")
        sums = [F.sum(F.get("s", F.lit(j))).alias(f"s{j}") for j in range(size)]
        for r in changed.groupBy("c").agg(F.sum("n").alias("n"), *sums).collect():  # k rows at most
            model.counts[r.c] += r.n
            model.sums[r.c] += np.array([r[f"s{j}"] for j in range(size)], np.int64)
        old = model.centroids
        some = model.counts > 0
        model.centroids = old.copy()
        model.centroids[some] = model.sums[some] // model.counts[some, None]  # floors
    return model, state


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = batch.column("x").flatten().to_numpy().astype("<i4") if batch.num_rows else np.zeros(0, "<i4")
        size = len(v) // max(batch.num_rows, 1)
        off = np.arange(batch.num_rows + 1, dtype=np.int32) * np.int32(4 * size)
        yield pa.record_batch([batch.column("id"), pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(off), pa.py_buffer(v)])], names=["id", "v"])


def _distances(c: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _vectors(batch.column("v"), c.shape[1]) - c[batch.column("cluster").to_numpy()]
                yield pa.record_batch([batch.column("id"), batch.column("cluster"), pa.array(np.einsum("ij,ij->i", d, d))], names=["id", "cluster", "distance"])

    return run


def clusters(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **how) -> DataFrame:
    """One row for each vector that ``fit`` takes: its ``id``, ``cluster``, squared
    ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid``, its cluster's in
    integers. ``how`` is what ``fit`` takes beside, and all else is as there."""
    spark = df.sparkSession
    model, state = fit(df, id_col, vector_col, **how)
    kind = state.schema["id"].dataType.simpleString()
    if not len(model.centroids):
        return spark.createDataFrame([], f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    near = keep(state.select("id", "v", "cluster").mapInArrow(_distances(model.centroids), f"id {kind}, cluster int, distance long"), "clusters")
    discard(state)
    own = {r.cluster: int(r.d) for r in near.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    per = spark.createDataFrame([(c, d, sum(own.values()), [int(x) for x in model.centroids[c]]) for c, d in own.items()], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return near.join(F.broadcast(per), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
