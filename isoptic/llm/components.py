"""Connected components of links that stay distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import tasks
from .store import drop, shared_path

#: Links that a task contracts, about.
EDGES = 200_000
#: A node with over one HUB-th of all links is a hub.
HUB = 1000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as stars: each node with the smallest that they reach."""
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not parts:
        return
    u, v = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, least = place[: len(u)], place[len(u) :], np.arange(len(nodes))
    while len(u):
        a, b = least[u], least[v]
        low = np.minimum(a, b)
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        while not np.array_equal(least, least[least]):
            least = least[least]
        open_ = least[u] != least[v]
        u, v = u[open_], v[open_]
    moved = np.flatnonzero(least != np.arange(len(nodes)))
    for k in range(0, len(moved), 100_000):
        at = moved[k : k + 100_000]
        yield pa.record_batch([pa.array(nodes[at]), pa.array(nodes[least[at]])], names=["u", "v"])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links`` (``a``, ``b``) to (``node``, ``root``): each node that has a
    link, and the smallest node it can reach.

    A large-star step points the larger neighbours of each node to the smallest;
    links of one node then meet in a task, which contracts them, and all that it
    holds, to stars. This ends when nothing changes, after a number of rounds that
    grows with the logarithm of a component's size; links that one task takes need
    no rounds. Each round is a table in the shared folder. Of a node with very many
    neighbours only minima meet in one place: there are few such nodes, and their
    neighbours get the minimum by broadcast.
    """
    spark = links.sparkSession
    path = before = None
    count = links.count()
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = edges.repartition(1).mapInArrow(_contracted, "u long, v long") if count <= EDGES else _stars(edges, ["u", "v"], count)
    for _ in range(rounds):
        if before is not None:
            turned = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            lead = shared_path(spark, "least")
            turned.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")).write.parquet(lead)
            least = spark.read.schema("u long, m long, n long").parquet(lead)
            # At most 2 * HUB nodes have over a HUB-th of all links, so they may be broadcast.
            hub = F.col("n") * HUB > F.lit(before[0])
            held = turned.join(F.broadcast(least.where(hub).select("u", "m")), "u", "left")
            rest = held.where("m is null").drop("m").join(least.where(~hub).select("u", "m"), "u")
            large = held.where("m is not null").unionByName(rest).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            edges = _stars(large, ["u"], before[0])
        here = shared_path(spark, "stars")
        edges.write.parquet(here)
        if path:
            drop(spark, path)
            drop(spark, lead)
        path, edges = here, spark.read.schema("u long, v long").parquet(here)
        if count <= EDGES:
            break
        # Stable once the edges, taken as a set, are those of the round before;
        # without a node that points to two or points on there is nothing to do.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if count <= EDGES:
        edges = edges.coalesce(1)  # one task's, of which the roots need no shuffle
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(edges: DataFrame, by: list[str], count: int) -> DataFrame:
    """Dealt by a node or by links, to as many tasks as the links are worth."""
    return edges.repartition(*by).coalesce(tasks(count, EDGES)).mapInArrow(_contracted, "u long, v long")
