"""Statistics of entities and cohorts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..frames import Keys, ordered
from .align import hinted


def two_level_median(df: DataFrame, value: str, entity: Keys, inner: Keys, panels: int | None = None, least: int = 0) -> DataFrame:
    """Median and population deviation for each ``inner`` group of an entity
    with more than ``least`` values; then the medians of both for the entity,
    if it has exactly ``panels`` such groups."""
    groups = df.groupBy(*entity, *inner).agg(F.median(value).alias("m"), F.stddev_pop(value).alias("s"), F.count(value).alias("n")).where(F.col("n") > least)
    out = groups.groupBy(*entity).agg(F.median("m").alias("median"), F.median("s").alias("std"), F.count(F.lit(1)).alias("groups"))
    return out if panels is None else out.where(F.col("groups") == panels)


def mean_std(df: DataFrame, value: str, keys: Keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def least_count(df: DataFrame, keys: Keys) -> DataFrame:
    """The smallest number of rows that an entity has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"))


def count_gate(df: DataFrame, keys: Keys, more_than: int | None = None, fewer_than: int | None = None, exactly: int | None = None) -> DataFrame:
    """Rows of the entities whose number of rows fits."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    fits = F.lit(True)
    for limit, test in ((more_than, lambda x: F.col("_n") > x), (fewer_than, lambda x: F.col("_n") < x), (exactly, lambda x: F.col("_n") == x)):
        if limit is not None:
            fits = fits & test(limit)
    return df.withColumn("_n", n).where(fits).drop("_n")


def ratio_gate(df: DataFrame, found: str | Column, expected: str | Column, low: float = 0.8, high: float = 1.2) -> DataFrame:
    """Rows with low < found / expected < high; not those that expect 0."""
    ratio = F.try_divide(F.col(found) if isinstance(found, str) else found, F.col(expected) if isinstance(expected, str) else expected)
    return df.where((ratio > low) & (ratio < high))


def roi_shares(df: DataFrame, y: str, event: str, keys: Keys, utterance: str, order: str, limit: float = C.KEY_AREA_BOTTOM, first: int = 30) -> DataFrame:
    """For each utterance: share of samples above ``limit``, share of
    fixations, and whether the mean of its ``first`` samples lies ``up``."""
    rank = F.row_number().over(ordered([*keys, utterance], order))
    return df.withColumn("_n", rank).groupBy(*keys, utterance).agg(
        F.avg((F.col(y) < limit).cast("double")).alias("key_share"),
        F.avg((F.col(event) == C.FIXATION).cast("double")).alias("fixation_share"),
        F.when(F.avg(F.when(F.col("_n") <= first, F.col(y))) < limit, "up").otherwise("down").alias("place"),
    )


def mean_roi_shares(shares: DataFrame, keys: Keys, utterance: str, parity: bool = False) -> DataFrame:
    """Means over utterances; with ``parity`` the last utterance's alone."""
    pick = (lambda c: F.max_by(c, utterance)) if parity else F.avg
    return shares.groupBy(*keys).agg(pick("key_share").alias("key_share"), pick("fixation_share").alias("fixation_share"))


def closest_run(df: DataFrame, x: str, y: str, target_x: str, target_y: str, event: str, keys: Keys, segment: str, order: str, parity: bool = False, name: str = "distance") -> DataFrame:
    """Smallest distance between a segment's target and the mean position of one
    of its fixations; infinite without any. With ``parity`` the runs are those
    that a rise and a fall of the code bound, which are saccades."""
    from .label import with_runs

    by = [*keys, segment]
    code = C.SACCADE if parity else C.FIXATION
    runs = with_runs(df, event, by, order)
    means = runs.groupBy(*by, "run").agg(F.first(event).alias(event), *[F.avg(c).alias(c) for c in (x, y)], *[F.first(c).alias(c) for c in (target_x, target_y)])
    d = F.hypot(F.col(x) - F.col(target_x), F.col(y) - F.col(target_y))
    return means.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col(event) == code, d)), F.lit(float("inf"))).alias(name))


def agreement(df: DataFrame, a: str, b: str, keys: Keys, parity: bool = False) -> DataFrame:
    """Percentage of samples with the same label; with ``parity`` 100 times the
    mean of the bitwise AND of the codes."""
    same = F.col(a).bitwiseAND(F.col(b)).cast("double") if parity else (F.col(a) == F.col(b)).cast("double")
    return df.groupBy(*keys).agg((F.avg(same) * 100).alias("agreement"))


def mse(df: DataFrame, a: str, b: str, keys: Keys = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.pow(F.col(a) - F.col(b), 2)).alias("mse"))


# Reliability.

#: Of a permutation's key: multipliers of repetition and place, a seed, and a
#: multiplicative hash modulo a prime.
_REP, _POS, _HASH, _PRIME = 7919, 104729, 2654435761, 4294967291


#: Subjects and repetitions of a block, which is one group of a task.
SUBJECTS, REPETITIONS = 512, 250
_SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def _permutations(first: int, last: int, least: int, seed: int) -> np.ndarray:
    """Places in random orders, the same wherever they are computed: (repetition, rank)."""
    rep, pos = np.arange(first, last)[:, None], np.arange(least)[None]
    return np.argsort(((rep * _REP + pos * _POS + seed) * _HASH) % _PRIME, axis=1, kind="stable")


def _half_sums(v: np.ndarray, order: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums over subjects (repetition, length, sum) of the means of both halves: what
    Pearson's r is made of. NaN is a missing value, and a subject without a half counts
    nowhere."""
    out = np.zeros((len(order), len(lengths), len(_SUMS)))
    held, v = (~np.isnan(v)).astype(np.float64), np.nan_to_num(v)
    ends = np.concatenate([lengths, 2 * lengths]) - 1
    for k, places in enumerate(order):
        # Running sums in the permuted order hold every length at once.
        total, count = (np.cumsum(x[:, places[: ends.max() + 1]], axis=1)[:, ends] for x in (v, held))
        l = len(lengths)  # noqa: E741
        na, nb = count[:, :l], count[:, l:] - count[:, :l]
        ok = (na > 0) & (nb > 0)
        a = np.where(ok, total[:, :l] / np.maximum(na, 1), 0)
        b = np.where(ok, (total[:, l:] - total[:, :l]) / np.maximum(nb, 1), 0)
        out[k] = np.stack([ok.sum(axis=0), a.sum(axis=0), b.sum(axis=0), (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)], axis=1)
    return out


def split_half(values: DataFrame, lengths: Sequence[int], repetitions: int, least: int, subject: str = "subject", pos: str = "pos", value: str = "v", seed: int = C.SHUFFLE_SEED) -> DataFrame:
    """Pearson's r over subjects of the means of two random halves, for each
    length ``l`` and ``rep``. A repetition permutes the first ``least`` places
    alike for all subjects and takes ``l`` and the next ``l`` of them; missing and null
    values are left out of a mean. r is null where it isn't defined.

    Subjects are cut in blocks of ``SUBJECTS`` and repetitions in blocks of
    ``REPETITIONS``; a task takes one block of each, a matrix of values and the
    repetitions' orders, which it makes itself. For each repetition running sums in its
    order give both means for every length, so work is linear in ``least`` and almost free
    of the number of lengths. Tasks give sums that add up to r; nothing is broadcast, and
    rows are as many as blocks of subjects times lengths times repetitions.
    """
    wanted = np.array(sorted({int(x) for x in lengths}), np.int64)
    if len(wanted) and (wanted[0] < 1 or 2 * wanted[-1] > least):
        raise ValueError(f"halves of 1 to {least // 2} places")
    schema = "l int, rep long, " + ", ".join(f"{c} double" for c in _SUMS)
    if not len(wanted) or repetitions < 1:
        return values.sparkSession.createDataFrame([], "l int, rep long, r double")
    usable = values.where((F.col(pos) >= 0) & (F.col(pos) < least) & F.col(value).isNotNull() & F.col(subject).isNotNull())
    # Sums of squares lose digits far from zero: values are taken from about their mean.
    centre = usable.agg(F.avg(value)).first()[0] or 0.0
    rows = usable.groupBy(subject).agg(F.collect_list(F.struct(F.col(pos).cast("int").alias("p"), (F.col(value).cast("double") - centre).alias("v"))).alias("_all"))
    blocks = max(1, -(-rows.count() // SUBJECTS))
    parts = F.explode(F.sequence(F.lit(0), F.lit(-(-repetitions // REPETITIONS) - 1)))
    dealt = rows.select("_all", F.pmod(F.xxhash64(subject), F.lit(blocks)).alias("_s"), parts.alias("_r"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        first = key[1].as_py() * REPETITIONS
        last = min(first + REPETITIONS, repetitions)
        lists = table.column("_all").combine_chunks()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        held = lists.flatten()
        v = np.full((len(lists), least), np.nan)
        v[row, held.field("p").to_numpy()] = held.field("v").to_numpy()
        sums = _half_sums(v, _permutations(first, last, least, seed), wanted).reshape(-1, len(_SUMS))
        n = last - first
        cols = {"l": np.tile(wanted, n).astype(np.int32), "rep": np.repeat(np.arange(first, last), len(wanted))} | dict(zip(_SUMS, sums.T, strict=True))
        return pa.table({k: pa.array(np.ascontiguousarray(x)) for k, x in cols.items()})

    sums = dealt.groupBy("_s", "_r").applyInArrow(run, schema).groupBy("l", "rep").agg(*[F.sum(c).alias(c) for c in _SUMS])
    n = F.col("n")
    across, up, down = n * F.col("sab") - F.col("sa") * F.col("sb"), n * F.col("saa") - F.col("sa") * F.col("sa"), n * F.col("sbb") - F.col("sb") * F.col("sb")
    return sums.select("l", "rep", F.when((n > 1) & (up > 0) & (down > 0), across / F.sqrt(F.when(up > 0, up)) / F.sqrt(F.when(down > 0, down))).alias("r"))


def reliability_curve(values: DataFrame, low: int, high: int, repetitions: int, least: int, folder: str | None = None, step: int = 16, **options) -> DataFrame:
    """Mean r for each length from max(5, low) to high - 1.

    With ``folder``, one that driver and executors share, lengths are written ``step``
    at a time, and those that it holds already, of an earlier run with the same
    arguments, are not computed again.
    """
    spark, lengths = values.sparkSession, list(range(max(5, low), high))

    def curve(of: Sequence[int]) -> DataFrame:
        return split_half(values, of, repetitions, least, **options).groupBy("l").agg(F.avg("r").alias("reliability"))

    if folder is None:
        return curve(lengths)
    there = spark._jvm.org.apache.hadoop.fs.Path(folder)
    exists = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    schema = "l int, reliability double"
    done = {r.l for r in spark.read.schema(schema).parquet(folder).select("l").collect()} if exists else set()
    left = [n for n in lengths if n not in done]
    for k in range(0, len(left), step):
        curve(left[k : k + step]).coalesce(1).write.mode("append").parquet(folder)
    if not exists and not left:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder).where(F.col("l").between(max(5, low), high - 1))


def half_correlation(df: DataFrame, value: str, subject: str, order: str) -> DataFrame:
    """r over subjects of the means of odd and even samples."""
    n = F.row_number().over(ordered([subject], order))
    means = df.withColumn("_n", n).groupBy(subject).agg(F.avg(F.when(F.col("_n") % 2 == 1, F.col(value))).alias("_a"), F.avg(F.when(F.col("_n") % 2 == 0, F.col(value))).alias("_b"))
    return means.agg(F.corr("_a", "_b").alias("r"))


# Histograms.


def histogram(df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None, keys: Keys = ()) -> DataFrame:
    """Counts of equal bins from ``low`` to ``high`` (found if not given), the
    last of which is closed; values outside and NULL count nowhere."""
    if low is None or high is None:
        ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        rows = df.join(hinted(ends))
    else:
        rows = df.withColumns({"_lo": F.lit(float(low)), "_hi": F.lit(float(high))})
    at = F.least(F.floor(F.try_divide((F.col(value) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))), F.lit(bins - 1))
    inside = rows.where((F.col(value) >= F.col("_lo")) & (F.col(value) <= F.col("_hi")))
    return inside.groupBy(*keys, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def extents(df: DataFrame, cols: Sequence[str], t: str, keys: Keys = ()) -> DataFrame:
    """Largest magnitude of each column, first and last time."""
    return df.groupBy(*keys).agg(*[F.max(F.abs(c)).alias(f"{c}_max") for c in cols], F.min(t).alias("t_min"), F.max(t).alias("t_max"))
