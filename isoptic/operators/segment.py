"""Segmentation of signals by energy, and what intervals it gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..frames import Keys, ordered, whole


def rms_frames(samples: DataFrame, value: str, keys: Keys, order: str, frame: int = C.RMS_FRAME, hop: int = C.RMS_HOP) -> DataFrame:
    """Energy of frames centred at every ``hop``-th sample, zeros beyond the
    ends: ``frame`` (from 0) and ``rms``.

    Samples are summed into blocks of a hop first, so that the overlap of
    frames multiplies blocks and not samples. ``frame`` is a multiple of 2 hops.
    """
    if frame % (2 * hop):
        raise ValueError("frame must be a multiple of twice the hop")
    half = frame // hop // 2
    blocks = samples.groupBy(*keys, F.floor(F.col(order) / hop).alias("_block")).agg(F.sum(F.pow(value, 2)).alias("_sum"), F.max(order).alias("_last"))
    ends = blocks.groupBy(*keys).agg(F.max("_last").alias("_last"))
    every = ends.select(*keys, F.explode(F.sequence(F.lit(0), F.floor((F.col("_last") + 1) / hop))).alias("frame"))
    spread = blocks.select(*keys, "_sum", F.explode(F.sequence(F.greatest(F.col("_block") - (half - 1), F.lit(0)), F.col("_block") + half)).alias("frame"))
    sums = spread.groupBy(*keys, "frame").agg(F.sum("_sum").alias("_sum"))
    return every.join(sums, [*keys, "frame"], "left").select(*keys, "frame", F.sqrt(F.coalesce("_sum", F.lit(0.0)) / frame).alias("rms"))


def quiet(samples: DataFrame, value: str, keys: Keys, limit: float = C.NOISE_LIMIT) -> DataFrame:
    """Keys of recordings whose median magnitude is no larger than ``limit``."""
    return samples.groupBy(*keys).agg(F.median(F.abs(value)).alias("_m")).where(F.col("_m") <= limit).select(*keys)


def above_threshold(df: DataFrame, value: str, keys: Keys, share: float = 0.25, name: str = "active") -> DataFrame:
    """1 where the value, scaled to [0, 1] within its series, is at least the
    median plus ``share`` of the population deviation, and over 0; else 0. A
    constant series is never active."""
    p = whole(keys)
    scaled = df.withColumn("_v", F.try_divide(F.col(value) - F.min(value).over(p), F.max(value).over(p) - F.min(value).over(p)))
    cut = F.median("_v").over(p) + F.stddev_pop("_v").over(p) * share
    return scaled.withColumn(name, F.coalesce(((F.col("_v") >= cut) & (F.col("_v") > 0)).cast("int"), F.lit(0))).drop("_v")


def edges(df: DataFrame, active: str, keys: Keys, order: str, name: str = "edge", lead_in: bool = True) -> DataFrame:
    """+1 at the sample before activity begins and -1 at the last active one,
    else 0. With ``lead_in`` a series that begins active has its +1 there."""
    w = ordered(keys, order)
    step = F.coalesce(F.lead(active).over(w) - F.col(active), F.lit(0))
    if lead_in:
        step = F.when((F.row_number().over(w) == 1) & (F.col(active) == 1), 1).otherwise(step)
    return df.withColumn(name, step)


def intervals(df: DataFrame, edge: str, keys: Keys, order: str, scale: int = 1, last: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """The n-th +1 with the n-th -1 as ``start`` and ``end``, in samples of
    ``scale`` for each step of ``order``, where ``end - start >= least``. An
    unclosed start ends at the series' ``last``, or is left out without it."""
    marks = df.where(F.col(edge) != 0)
    n = F.row_number().over(ordered([*keys, edge], order))
    numbered = marks.withColumn("ord", n)
    a = numbered.where(F.col(edge) == 1).select(*keys, "ord", (F.col(order) * scale).cast("long").alias("start"))
    b = numbered.where(F.col(edge) == -1).select(*keys, "ord", (F.col(order) * scale).cast("long").alias("end"))
    both = a.join(b, [*keys, "ord"], "left")
    if last is not None:
        both = both.join(last, list(keys), "left").withColumn("end", F.coalesce("end", F.col("last").cast("long"))).drop("last")
    return both.where(F.col("end") - F.col("start") >= least)


def speech_events(samples: DataFrame, value: str, keys: Keys, order: str, rate: int, frame: int = C.RMS_FRAME, hop: int = C.RMS_HOP, min_seconds: float = C.MIN_SPEECH_SECONDS, noise: float = C.NOISE_LIMIT) -> DataFrame:
    """Speech in audio: ``t`` (microseconds), ``signal_index`` and
    ``sentence_breaks`` (+1 begins, -1 ends) of recordings that are quiet."""
    kept = samples.join(quiet(samples, value, keys, noise), list(keys), "left_semi")
    last = kept.groupBy(*keys).agg(F.max(order).alias("last"))
    marked = edges(above_threshold(rms_frames(kept, value, keys, order, frame, hop), "rms", keys), "active", keys, "frame")
    spans = intervals(marked, "edge", keys, "frame", hop, last, min_seconds * rate).join(last, list(keys))
    events = spans.select(*keys, "ord", F.explode(F.array(F.struct(F.col("start").alias("signal_index"), F.lit(1).alias("sentence_breaks")), F.struct(F.col("end").alias("signal_index"), F.lit(-1).alias("sentence_breaks")))).alias("x"), "last").select(*keys, "ord", "x.*", "last")
    t = F.round(F.least("signal_index", "last") / F.lit(float(rate)) * 1_000_000, 5)
    return events.select(*keys, "ord", t.alias("t"), "signal_index", "sentence_breaks")


def utterance_gaps(events: DataFrame, t: str, keys: Keys, order: str, parity: bool = False, mark: str = "sentence_breaks", name: str = "interval") -> DataFrame:
    """Time from the begin of one utterance to that of the next. With
    ``parity``, over the first half of all begins and ends, each to the next."""
    w = ordered(keys, order, F.desc(mark))
    if not parity:
        return events.where(F.col(mark) == 1).withColumn(name, F.lead(t).over(w) - F.col(t)).where(F.col(name).isNotNull())
    numbered = events.withColumns({name: F.lead(t).over(w) - F.col(t), "_n": F.row_number().over(w), "_all": F.count(F.lit(1)).over(whole(keys))})
    return numbered.where((F.col("_n") <= F.floor(F.col("_all") / 2)) & F.col(name).isNotNull()).drop("_n", "_all")
