"""Fixed-length sequences out of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..frames import Keys, ordered, running, whole
from .align import hinted


def gap_sessions(df: DataFrame, t: str, keys: Keys, order: str, factor: float = 1.0, add: float = 2.0, name: str = "session", parity: bool = False, least: int = 0) -> DataFrame:
    """A number for each stretch of a series without a gap over ``factor`` times
    its median gap plus ``add``; stretches under ``least`` rows are dropped.

    With ``parity`` (``least`` is then the sequence length) stretches are those
    of a scan that starts anew one row early after a stretch that is too short,
    and never closes the last one.
    """
    w, p = ordered(keys, order), whole(keys)
    gaps = df.withColumn("_gap", F.col(t) - F.lag(t).over(w))
    cut = gaps.withColumn("_cut", (F.col("_gap") > F.median("_gap").over(p) * factor + add).cast("int"))
    out = cut.withColumn(name, F.coalesce(F.sum("_cut").over(running(keys, order)), F.lit(0))).drop("_gap")
    if not parity:
        out = out.drop("_cut")
        return out if least <= 1 else out.withColumn("_n", F.count(F.lit(1)).over(whole([*keys, name]))).where(F.col("_n") >= least).drop("_n")
    # Ends of stretches in order: ``i`` is where the next one starts.
    at = out.withColumn("_at", F.row_number().over(w) - 1)
    ends = at.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("_cut") == 1, F.col("_at") - 1))).alias("_ends"))
    start = F.struct(F.lit(0).alias("i"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))
    step = lambda s, j: F.when(j - s["i"] < least, F.struct(j.alias("i"), s["out"].alias("out"))).otherwise(F.struct((j + 1).alias("i"), F.concat(s["out"], F.array(F.struct(s["i"].alias("a"), j.alias("b")))).alias("out")))
    spans = ends.select(*keys, F.posexplode(F.aggregate("_ends", start, step, lambda s: s["out"])).alias("_no", "_span")).select(*keys, F.col("_no").alias(name), "_span.a", "_span.b")
    return at.drop(name, "_cut").join(spans, list(keys)).where((F.col("_at") >= F.col("a")) & (F.col("_at") <= F.col("b"))).drop("_at", "a", "b")


def strided_windows(df: DataFrame, keys: Keys, order: str, length: int = C.SEQUENCE_LENGTH + 1, stride: int = C.STRIDE, parity: bool = False) -> DataFrame:
    """``lo`` and ``hi`` (places from 0, ``hi`` exclusive) of windows at every
    ``stride``-th place; where one would reach the end of the series it is its
    last ``length`` samples. Repeats of that one are dropped unless ``parity``.
    Shorter series have none."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= length)
    placed = n.select(*keys, "_n", F.posexplode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(stride))).alias("window", "_p"))
    out = placed.select(*keys, "window", F.when(F.col("_p") + length < F.col("_n"), F.col("_p")).otherwise(F.col("_n") - length).cast("long").alias("lo"))
    if not parity:
        out = out.groupBy(*keys, "lo").agg(F.min("window").alias("window"))
    return out.withColumn("hi", F.col("lo") + length)


def sequences(df: DataFrame, windows: DataFrame, keys: Keys, order: str, *cols: str, name: str = "samples") -> DataFrame:
    """Each window with its samples as an array of structs, in order.

    A sample goes to the few windows over it by an equality with their buckets
    of a window's length, so the join's work is that of its result.
    """
    placed = df.withColumn("_at", F.row_number().over(ordered(keys, order)) - 1)
    size = windows.select((F.col("hi") - F.col("lo")).alias("n")).agg(F.max("n")).first()[0] or 1
    cut = windows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))))
    rows = placed.withColumn("_b", F.floor(F.col("_at") / size)).join(cut, [*keys, "_b"]).where((F.col("_at") >= F.col("lo")) & (F.col("_at") < F.col("hi")))
    got = rows.groupBy(*keys, "window", "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("_at", *cols))).alias("_all"))
    return got.withColumn(name, F.transform("_all", lambda x: F.struct(*[x[c].alias(c) for c in cols]))).drop("_all")


def pad(column: Column, length: Column | int, value: Column | None = None) -> Column:
    """An array with zeros (or ``value``) added up to ``length``."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.concat(column, F.array_repeat(F.lit(0.0) if value is None else value, F.greatest(n - F.size(column), F.lit(0)).cast("int")))


def collate(df: DataFrame, array: str, batch: str) -> DataFrame:
    """Arrays padded to the longest of their batch, with their share of it."""
    longest = F.max(F.size(array)).over(whole([batch]))
    return df.withColumn("_l", longest).withColumn("share", F.try_divide(F.size(array), F.col("_l"))).withColumn(array, pad(F.col(array), F.col("_l"))).drop("_l")


def stripped(samples: Column, length: int = C.SEQUENCE_LENGTH) -> Column:
    """The first ``length`` samples."""
    return F.slice(samples, 1, length)


def augmented(df: DataFrame, cols: list[str], levels: tuple[float, ...], seed: int = C.SHUFFLE_SEED) -> DataFrame:
    """Normal noise of half a random level added to each column, seeded. For
    training only."""
    level = F.get(F.array(*[F.lit(float(x)) for x in levels]), F.floor(F.rand(seed) * len(levels)).cast("int"))
    noisy = df.withColumn("_level", level)
    return noisy.withColumns({c: F.col(c) + F.randn(seed + 1 + i) * F.col("_level") / 2 for i, c in enumerate(cols)}).drop("_level")


def shuffled(df: DataFrame, *ids: str, seed: int = C.SHUFFLE_SEED) -> DataFrame:
    """A random order that depends on ids and seed alone."""
    return df.orderBy(F.xxhash64(*ids, F.lit(seed)), *ids)


def seeded_batches(df: DataFrame, ids: Keys, size: int, seed: int = C.SHUFFLE_SEED, name: str = "batch") -> DataFrame:
    """``df`` with the number of each row's batch, of ``size`` rows but the last, in a
    random order that depends on ids and seed alone.

    No row is sorted against all others: rows are dealt to buckets by their place in that
    order, buckets are counted, and a row's number is that of the buckets before its own
    and its place within. There are so many buckets that one has some thousand rows,
    and only their counts are added up in one task. Rows that repeat all ids are told apart by nothing and get
    numbers as they come.
    """
    fine = F.xxhash64(*ids, F.lit(seed))
    rows = max(1, df.count())
    buckets = max(1, rows // 4096)
    # The bucket follows the order: the upper bits of the hash, from the smallest.
    placed = df.withColumns({"_h": fine, "_b": F.floor((fine.cast("double") / 2.0**64 + 0.5) * buckets).cast("long")})
    placed = placed.withColumn("_b", F.least("_b", F.lit(buckets - 1)))
    counts = placed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_b", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_b").orderBy("_h", *ids))
    numbered = placed.withColumn("_at", within).join(hinted(starts), "_b")
    return numbered.withColumn(name, F.floor((F.col("_before") + F.col("_at") - 1) / size).cast("long")).select(*df.columns, name)
