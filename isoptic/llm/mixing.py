"""Mixing sources to target weights by capped water-filling.

Only ids, sources and sizes are handled after the first scan. Targets come from
one row a source; documents are taken in a seeded random order until the
fractional part of a source's target is met, which needs the sum of each slice
of that order and the rows of the one slice in which the target falls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import hinted, salted_join, tasks
from .store import keep
from .text import unused, word_count

#: Hexadecimal digits of the random order: 13 fit in a long and in a double.
DIGITS = 13


def cyclic_weights(weights: tuple[float, ...] = (3, 1, 2)) -> Callable[[DataFrame], DataFrame]:
    """Weights that repeat over sources in code point order, null last."""

    def add(sources: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
        return sources.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank, F.lit(len(weights)))))

    return add


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """``sources`` (``source_size``, ``weight``) with ``target``.

    ``share`` times all sizes are dealt by weight, no source getting over
    ``max_epochs`` times its size; the excess goes to the others by weight,
    and again, until none is above. Sources that fill up do so in the order of
    cap over weight, so running sums in that order find the level at once. If
    all fill up, every target is its cap. One row a source, with weights over 0.
    """
    order = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    step = (
        sources.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("_budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        # This source fills up if the level over it and those after it tops it.
        .withColumn("_fills", F.col("weight") * (F.col("_budget") - F.col("_full")) >= F.col("_cap") * F.col("_open"))
    )
    level = (
        step.withColumn("_capped", F.sum(F.when(F.col("_fills"), F.col("_cap")).otherwise(0.0)).over(everything))
        .withColumn("_rest", F.sum(F.when(F.col("_fills"), 0.0).otherwise(F.col("weight"))).over(everything))
    )
    target = F.when(F.col("_fills"), F.col("_cap")).otherwise(F.col("weight") * (F.col("_budget") - F.col("_capped")) / F.col("_rest"))
    return level.withColumn("target", target).select(*sources.columns, "target")


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weigh: Callable[[DataFrame], DataFrame] | None = None,
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 42,
    slice_rows: int = 50_000,
    size: Callable[[Column], Column] = word_count,
) -> DataFrame:
    """One row for each of ``docs``: id, ``source``, ``size``, ``source_size``,
    ``target``, ``copies`` and ``taken`` (``copies`` times ``size``).

    Every document is taken floor(target / source_size) times, and once more
    if it lies early enough in the source's seeded random order; a source's
    sum is within half a document of its target. The order depends on seed and
    id alone, so reruns agree. A null text has size 0, a null source is a
    source of its own, a null id is the id ''. Rows that repeat an id stand
    together in the order, by size. A source of size 0 has target 0, and no
    copies. An empty table gives an empty result.
    """
    weigh = weigh or cyclic_weights()
    order = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, DIGITS), 16, 10).cast("long")
    sizes = keep(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size(F.col(text_col)).alias("size"), order.alias("_order")), "mixture")
    # As many slices as the rows are worth, so that the one that is sorted is small.
    width = 16**DIGITS // tasks(sizes.count(), slice_rows, 256) + 1
    sizes = sizes.withColumn("_slice", F.floor(F.col("_order") / F.lit(width)).cast("int"))
    per_slice = keep(sizes.groupBy("source", "_slice").agg(F.sum("size").alias("_sum")), "slices")
    totals = water_fill(weigh(per_slice.groupBy("source").agg(F.sum("_sum").alias("source_size"))), share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    totals = totals.withColumn("_whole", whole.cast("int")).withColumn("_more", F.col("target") - F.col("_whole") * F.col("source_size"))
    named = totals.withColumn("_key", F.struct("source")).drop("source")
    up_to = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    plan = keep(
        per_slice.withColumn("_key", F.struct("source"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(up_to), F.lit(0)))
        .join(named, "_key")
        # -1: all of the slice is taken once more, 1: none, 0: the target is met in it.
        .withColumn("_side", F.when(F.col("_before") + F.col("_sum") <= F.col("_more"), -1).when(F.col("_before") >= F.col("_more"), 1).otherwise(0))
        .select("_key", "_slice", "_before", "source_size", "target", "_whole", "_more", "_side"),
        "plan",
    )
    rows = salted_join(sizes.withColumn("_key", F.struct("source")), plan, ["_key", "_slice"], ["id", "size"], how="inner", salts=4)
    in_slice = Window.partitionBy("_key", "_slice").orderBy("_order", "size", "id").rowsBetween(Window.unboundedPreceding, -1)
    met = rows.where("_side = 0").withColumn("_at", F.col("_before") + F.coalesce(F.sum("size").over(in_slice), F.lit(0)))
    met = met.withColumn("_extra", (F.col("_at") + F.col("size") / 2.0 < F.col("_more")).cast("int")).drop("_at")
    rest = rows.where("_side <> 0").withColumn("_extra", (F.col("_side") == -1).cast("int"))
    copies = (F.col("_whole") + F.col("_extra")).cast("int")
    return (
        rest.unionByName(met)
        .withColumn("copies", F.when(F.col("source_size") > 0, copies).otherwise(0))
        .select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with each row repeated as often as ``mixture`` takes it.

    Rows that repeat an id repeat as the one with most copies. Empty texts
    have nothing to give to the mix; they follow their place in the order.
    """
    i, copies, copy = unused(docs.columns, "id", "copies", "copy")
    taken = mixture(docs, id_col=id_col, **options).groupBy(F.col("id").alias(i)).agg(F.max("copies").alias(copies))
    taken = keep(taken.where(F.col(copies) > 0), "copies")
    found = docs.join(hinted(taken), F.col(id_col).eqNullSafe(F.col(i)))
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
