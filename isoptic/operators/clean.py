"""Cleaning of sampled series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..frames import Keys, following, ordered, running, whole


def difference(df: DataFrame, col: str, keys: Keys, order: str, name: str, ahead: bool = False) -> DataFrame:
    """First difference, at the later sample or, with ``ahead``, the earlier."""
    w = ordered(keys, order)
    return df.withColumn(name, F.lead(col).over(w) - F.col(col) if ahead else F.col(col) - F.lag(col).over(w))


def bar_widths(df: DataFrame, col: str, keys: Keys, order: str, name: str = "width") -> DataFrame:
    """Differences with 0 for the first sample."""
    return df.withColumn(name, F.coalesce(F.col(col) - F.lag(col).over(ordered(keys, order)), F.lit(0)))


def mask_outliers(df: DataFrame, cols: Sequence[str], keys: Keys, order: str, factor: float = C.OUTLIER_FACTOR) -> DataFrame:
    """NULL for samples whose step from the one before is larger than the mean
    step plus ``factor`` population deviations of the series. Each column is
    judged by itself; a step from or to a missing sample masks nothing."""
    w, p = ordered(keys, order), whole(keys)
    steps = df.withColumns({f"_step_{c}": F.abs(F.col(c) - F.lag(c).over(w)) for c in cols})
    cut = {c: F.stddev_pop(f"_step_{c}").over(p) * factor + F.avg(f"_step_{c}").over(p) for c in cols}
    masked = steps.withColumns({c: F.when(F.col(f"_step_{c}").isNull() | (F.col(f"_step_{c}") <= cut[c]), F.col(c)) for c in cols})
    return masked.drop(*[f"_step_{c}" for c in cols])


def interpolate(df: DataFrame, cols: Sequence[str], keys: Keys, order: str, strict: bool = False) -> DataFrame:
    """Missing samples on the line between their neighbours, over the ordinal
    ``order``; flat beyond the first and last known sample. A series without
    any stays NULL, or fails with ``strict``."""
    back, ahead = running(keys, order), following(keys, order)
    at = {c: F.when(F.col(c).isNotNull(), F.col(order)) for c in cols}
    around = df.withColumns(
        {f"_v0_{c}": F.last(c, True).over(back) for c in cols}
        | {f"_i0_{c}": F.last(at[c], True).over(back) for c in cols}
        | {f"_v1_{c}": F.first(c, True).over(ahead) for c in cols}
        | {f"_i1_{c}": F.first(at[c], True).over(ahead) for c in cols}
    )

    def value(c: str) -> Column:
        v0, v1, i0, i1 = (F.col(f"_{x}_{c}") for x in ("v0", "v1", "i0", "i1"))
        line = v0 + (v1 - v0) * (F.col(order) - i0) / (i1 - i0)
        found = F.when(F.col(c).isNotNull(), F.col(c)).when(i0.isNull(), v1).when(i1.isNull(), v0).otherwise(line)
        return F.coalesce(found, F.raise_error(F.lit(f"{c}: a series without any known sample")).cast("double")) if strict else found

    filled = around.withColumns({c: value(c) for c in cols})
    return filled.drop(*[f"_{x}_{c}" for x in ("v0", "v1", "i0", "i1") for c in cols])


def clean(df: DataFrame, cols: Sequence[str], keys: Keys, order: str, factor: float = C.OUTLIER_FACTOR) -> DataFrame:
    """Outliers masked and then interpolated, in one exchange and one sort."""
    return interpolate(mask_outliers(df, cols, keys, order, factor), cols, keys, order)


def drop_missing(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull())


def with_validity(df: DataFrame, col: str, name: str = "status") -> DataFrame:
    """1 where ``col`` is known, else 0."""
    return df.withColumn(name, F.col(col).isNotNull().cast("int"))


def quality_gate(df: DataFrame, cols: Sequence[str], keys: Keys, most: float = C.MAX_MISSING_SHARE) -> DataFrame:
    """Series in which floor(missing cells / 2) is under ``most`` of the rows."""
    missing = F.sum(sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0)))
    good = df.groupBy(*keys).agg(F.try_divide(F.floor(missing / 2), F.count(F.lit(1))).alias("_share")).where(F.col("_share") < most)
    return df.join(good.select(*keys), list(keys), "left_semi")


def smooth(df: DataFrame, cols: Sequence[str], keys: Keys, order: str, width: int = int(C.SMOOTHING_MS / (1000 / C.SAMPLE_RATE))) -> DataFrame:
    """Moving average of ``width`` samples that takes zeros beyond the ends, so
    that ends are attenuated. Of an even width the longer half lies behind."""
    w = ordered(keys, order).rowsBetween(-(width // 2), (width - 1) // 2)
    return df.withColumns({c: F.sum(c).over(w) / width for c in cols})


def rebase(df: DataFrame, col: str, keys: Keys, order: str, name: str | None = None) -> DataFrame:
    """Time from the first sample."""
    return df.withColumn(name or col, F.col(col) - F.first(col).over(running(keys, order)))


def min_max(df: DataFrame, cols: Sequence[str], keys: Keys, eps: float = 1e-10) -> DataFrame:
    """Each column of each series to [0, 1]. With ``eps`` = 0 a constant series
    becomes NULL."""
    p = whole(keys)
    scaled = {c: F.try_divide(F.col(c) - F.min(c).over(p), F.max(c).over(p) - F.min(c).over(p) + F.lit(eps)) for c in cols}
    return df.withColumns(scaled)


def downsample(df: DataFrame, keys: Keys, order: str, every: int = 6) -> DataFrame:
    """Every ``every``-th sample from the first."""
    n = F.row_number().over(ordered(keys, order))
    return df.withColumn("_n", n).where((F.col("_n") - 1) % every == 0).drop("_n")


def head(df: DataFrame, keys: Keys, order: str, n: int | None = None) -> DataFrame:
    """The first ``n`` samples of each series; all with None. A negative ``n``
    leaves that many out at the end."""
    if n is None:
        return df
    rank = F.row_number().over(ordered(keys, order))
    limit = F.lit(n) if n >= 0 else F.count(F.lit(1)).over(whole(keys)) + n
    return df.withColumn("_n", rank).withColumn("_most", limit).where("_n <= _most").drop("_n", "_most")


def dominant_eye(df: DataFrame, eye: str = "dom_eye", parity: bool = False) -> DataFrame:
    """``x`` and ``y`` of the dominant eye: r is the right, anything else the
    left. Case doesn't matter, but with ``parity`` only a lower-case r counts."""
    right = (F.col(eye) if parity else F.lower(eye)) == "r"
    return df.withColumns({k: F.when(right, F.col(f"right_{k}")).otherwise(F.col(f"left_{k}")) for k in ("x", "y")})


def on_clock(df: DataFrame, keys: Keys, t: str, order: str, rate: float, stale: float | None = None, name: str = "frame") -> DataFrame:
    """Each series on a clock of ``rate`` frames a second from its first sample: a row for
    each ``frame`` and its ``clock`` time, with the sample last seen by then; of samples at
    one time the last by ``order``.

    One sort by series: each sample knows the next, and so the frames that are its own.
    With ``stale``, a frame more than so many seconds after its sample is left out. Rows
    without a time are ignored.
    """
    rows = df.where(F.col(t).isNotNull())
    w = ordered(keys, t, order)
    begun = F.col(t).cast("double") - F.min(F.col(t).cast("double")).over(whole(keys))
    timed = rows.withColumn("_t", begun)
    timed = timed.withColumn("_next", F.lead("_t").over(w))
    first = F.ceil(F.col("_t") * rate)
    last = F.coalesce(F.ceil(F.col("_next") * rate) - 1, F.floor(F.col("_t") * rate))
    if stale is not None:
        last = F.least(last, F.floor((F.col("_t") + stale) * rate))
    own = timed.withColumns({"_a": first.cast("long"), "_z": last.cast("long")}).where("_a <= _z")
    out = own.withColumn(name, F.explode(F.sequence("_a", "_z")))
    return out.withColumn("clock", F.col(t).cast("double") - F.col("_t") + F.col(name) / rate).drop("_t", "_next", "_a", "_z")
