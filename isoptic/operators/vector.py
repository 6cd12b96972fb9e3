"""Vectors: distances, assignment, clustering, components, model scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Centroids that are held by the driver and by each task, at most.
CENTROIDS = 10_000


def squared_distance(a: Column, b: Column) -> Column:
    """Of two arrays, in double precision."""
    pairs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def _one_row(few: DataFrame, collected: Column) -> DataFrame:
    """All of a table that is counted to be small, to be broadcast."""
    if few.limit(CENTROIDS + 1).count() > CENTROIDS:
        raise ValueError(f"over {CENTROIDS} vectors to compare all others with")
    return F.broadcast(few.agg(collected))


def nearest_centroid(df: DataFrame, centroids: DataFrame, vector: str, centroid: str = "centroid", name: str = "cluster") -> DataFrame:
    """``cluster`` and ``distance`` of the centroid nearest to each vector; of
    two as near the smallest. Centroids are few: they become one row of arrays,
    and more than ``CENTROIDS`` fail."""
    few = _one_row(centroids, F.array_sort(F.collect_list(F.struct(F.col(name).alias("c"), F.col(centroid).alias("v")))).alias("_c"))
    d = F.transform("_c", lambda z: F.struct(squared_distance(F.col(vector), z["v"]).alias("d"), z["c"].alias("c")))
    return df.join(few).withColumn("_best", F.array_min(d)).select(*df.columns, F.col("_best.c").alias(name), F.sqrt("_best.d").alias("distance"))


def pairwise_distances(left: DataFrame, right: DataFrame, left_id: str, right_id: str, vector: str) -> DataFrame:
    """Of a stated set ``right`` (such as centroids, ``CENTROIDS`` at most) with each
    row of ``left``."""
    r = right.select(F.col(right_id).alias("right_id"), F.col(vector).alias("_v"))
    few = _one_row(r, F.collect_list(F.struct("right_id", "_v")).alias("_all"))
    rows = left.select(F.col(left_id).alias("left_id"), F.col(vector).alias("_u")).join(few).select("left_id", "_u", F.explode("_all").alias("x"))
    return rows.select("left_id", "x.right_id", F.sqrt(squared_distance(F.col("_u"), F.col("x._v"))).alias("distance"))


def kmeans(df: DataFrame, vector: str, k: int = 7, iterations: int = 10, seed: int = 0) -> tuple[KMeansModel, DataFrame]:
    """The model and ``df`` with its ``cluster``. The start is k-means|| and a
    cluster that loses its rows keeps its centre; where the start is random and
    an empty cluster takes a random row, clusters can differ."""
    rows = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = KMeans(k=k, maxIter=iterations, seed=seed, featuresCol="_v", predictionCol="cluster").fit(rows)
    return model, model.transform(rows).drop("_v")


def clustering_loss(df: DataFrame, model: KMeansModel, vector: str, cluster: str = "cluster", fit: float = 10_000.0, apart: float = 0.001) -> DataFrame:
    """``fit`` times the mean squared distance to the centroids and ``apart``
    times the sum of 1 / (distance + 1e-6) over pairs of centroids."""
    centres = [[float(x) for x in c] for c in model.clusterCenters()]
    own = F.get(F.array(*[F.array(*[F.lit(x) for x in c]) for c in centres]), F.col(cluster))
    close = sum(1 / (sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5 + 1e-6) for i, a in enumerate(centres) for b in centres[i + 1 :])
    return df.agg((F.avg(squared_distance(F.col(vector), own) / F.size(vector)) * fit + apart * close).alias("loss"))


def _picked(id_: str, seed: int, *draw: int) -> Column:
    """An order of rows that depends on ids, seed and draw alone."""
    return F.md5(F.concat_ws(":", F.col(id_).cast("string"), *[F.lit(str(x)) for x in (seed, *draw)]))


def lloyd(df: DataFrame, id_col: str, vector: str, k: int = 7, iterations: int = 10, seed: int = 0, name: str = "cluster") -> tuple[list[list[float]], DataFrame]:
    """The centroids, and ``df`` with the ``cluster`` of each row.

    Every centroid starts at a row drawn by the seed; two can draw one row. A round
    assigns each row to the nearest centroid, of two as near the first, and makes each
    centroid the mean of its rows, or a drawn row where it has none. Clusters are those
    that the last round assigned, and the centroids the means of these. A round is one
    aggregate; only centroids come to the driver. Rows with a null id, a null vector, one of
    another size than the first row's or with a null in it are left out; without rows
    there are no centroids.
    """
    if not 0 < k <= CENTROIDS:
        raise ValueError(f"between 1 and {CENTROIDS} centroids")
    spark = df.sparkSession
    whole = F.coalesce(F.forall(vector, lambda x: x.isNotNull()), F.lit(False)) & F.col(id_col).isNotNull()
    size = df.where(whole).agg(F.min_by(F.size(vector), id_col)).first()[0]
    rows = df.where(whole & (F.size(vector) == (size or 0)))

    def drawn(*draws: tuple[int, ...]) -> list[list[float]]:
        got = rows.agg(*[F.min_by(vector, _picked(id_col, seed, *d)) for d in draws]).first()
        return [[float(x) for x in v] for v in got if v is not None]

    def assigned(centres: list[list[float]]) -> DataFrame:
        held = spark.createDataFrame(list(enumerate(centres)), f"{name} int, centroid array<double>")
        return nearest_centroid(rows, held, vector, name=name).drop("distance")

    centres = drawn(*[(0, j) for j in range(k)]) if size is not None else []
    if not centres:
        return [], df.where(F.lit(False)).withColumn(name, F.lit(None).cast("int"))
    out = assigned(centres) if iterations < 1 else None
    for number in range(1, iterations + 1):
        out = assigned(centres)
        means = out.groupBy(name).agg(*[F.avg(F.get(vector, F.lit(i))).alias(f"_m{i}") for i in range(size)]).collect()
        found = {r[name]: [float(r[f"_m{i}"]) for i in range(size)] for r in means}
        lost = [j for j in range(k) if j not in found]
        found |= dict(zip(lost, drawn(*[(number, j) for j in lost]) if lost else [], strict=True))
        centres = [found[j] for j in range(k)]
    return centres, out


def centroid_loss(df: DataFrame, centres: list[list[float]], vector: str, cluster: str = "cluster", fit: float = 10_000.0, apart: float = 0.001) -> DataFrame:
    """``fit`` times the mean squared difference to the centroids of the clusters, by
    component, and ``apart`` times the sum of 1 / (distance + 1e-6) over pairs of
    centroids; null without rows."""
    held = df.sparkSession.createDataFrame(list(enumerate(centres)), f"{cluster} int, _c array<double>")
    close = sum(1 / (sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5 + 1e-6) for i, a in enumerate(centres) for b in centres[i + 1 :])
    return df.join(F.broadcast(held), cluster).agg((F.avg(squared_distance(F.col(vector), F.col("_c")) / F.size(vector)) * fit + apart * close).alias("loss"))


def pca(df: DataFrame, vector: str, k: int = 3, name: str = "components") -> tuple[PipelineModel, DataFrame]:
    """``k`` principal components of centred vectors; signs are arbitrary."""
    rows = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    centre = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(rows)
    turn = PCA(k=k, inputCol="_c", outputCol="_p").fit(centre.transform(rows))
    model = PipelineModel([centre, turn])
    return model, model.transform(rows).withColumn(name, vector_to_array("_p")).drop("_v", "_c", "_p")


def score_sequences(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Batches through a model. ``load`` runs once a task and gives a function
    of a batch; it has to fail if weights are missing. The columns of
    ``schema`` are what the function returns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(run, schema)


def argmax_class(scores: Column, first: int = 1) -> Column:
    """The place of the largest score, counted from ``first``; of equal ones the first."""
    return (F.array_position(scores, F.array_max(scores)) - 1 + first).cast("int")
