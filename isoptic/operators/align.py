"""Joins of series with intervals, events and each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import Keys, following, ordered, running

#: Rows up to which a table of intervals, panels or targets is broadcast.
BROADCAST = 1_000_000


def hinted(df: DataFrame, most: int = BROADCAST) -> DataFrame:
    """``df`` to be broadcast if counted to be few rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def range_join(samples: DataFrame, intervals: DataFrame, keys: Keys, t: str, lo: str = "lo", hi: str = "hi", how: str = "inner", closed: bool = False) -> DataFrame:
    """Samples within intervals of the same ``keys``, open at both ends."""
    # Renamed first: both sides may stem from one table.
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    spans = intervals.withColumnsRenamed(names)
    inside = (F.col(t) >= F.col(lo)) & (F.col(t) <= F.col(hi)) if closed else (F.col(t) > F.col(lo)) & (F.col(t) < F.col(hi))
    for k, n in names.items():
        inside = inside & (F.col(k) == F.col(n))
    return samples.join(spans, inside, how).drop(*names.values())


def bucketed_range_join(samples: DataFrame, intervals: DataFrame, keys: Keys, t: str, width: float, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """``range_join`` for keys with very many samples: intervals go to each
    bucket of ``width`` that they touch, samples to their own, and both sides
    are dealt by key and bucket."""
    cut = intervals.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return range_join(samples.withColumn("_bucket", F.floor(F.col(t) / width)), cut, [*keys, "_bucket"], t, lo, hi).drop("_bucket")


def pair_in_order(starts: DataFrame, ends: DataFrame, keys: Keys, order: str, value: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """The n-th start with the n-th end; what has no partner is left out."""
    n = F.row_number().over(ordered(keys, order))
    a = starts.select(*keys, n.alias("ord"), F.col(value).alias(lo))
    b = ends.select(*keys, n.alias("ord"), F.col(value).alias(hi))
    return a.join(b, [*keys, "ord"])


def panel_intervals(messages: DataFrame, starts: Sequence[str], ends: Sequence[str], keys: Keys = ("recording_id",), t: str = "t_us", order: str = "seq", text: str = "text") -> DataFrame:
    """From the exact messages that open and close panels to ``ord``, ``lo``,
    ``hi`` and ``duration``. A recording needs as many of each as are named."""
    marks = messages.where(F.col(text).isin(*starts, *ends)).withColumn("_open", F.col(text).isin(*starts))
    whole = marks.groupBy(*keys).agg(F.count_if("_open").alias("_a"), F.count_if(~F.col("_open")).alias("_b")).where((F.col("_a") == len(starts)) & (F.col("_b") == len(ends)))
    marks = marks.join(whole.select(*keys), list(keys), "left_semi")
    return pair_in_order(marks.where("_open"), marks.where(~F.col("_open")), keys, order, t).withColumn("duration", F.col("hi") - F.col("lo"))


def first_match(left: DataFrame, right: DataFrame, on: Column, left_key: Sequence[str], order: str | Column) -> DataFrame:
    """Left join that keeps the first match of each left row in ``order``. ``on``
    should hold an equality: without one every row meets every other."""
    joined = left.join(right, on, "left")
    n = F.row_number().over(Window.partitionBy(*[left[k] for k in left_key]).orderBy(order))
    return joined.withColumn("_n", n).where("_n = 1").drop("_n")


def image_of_panel(panels: DataFrame, images: DataFrame, code: str = "panel", path: str = "path") -> DataFrame:
    """The first image, by path, whose name ends with the panel's code."""
    named = images.withColumn(code, F.regexp_extract(path, r"_([^_/]+)\.jpg$", 1)).where(F.col(code) != "")
    one = named.groupBy(code).agg(F.min(path).alias(path))
    return panels.join(one, code, "left")


def audio_of_panel(panels: DataFrame, audio: DataFrame, code: str = "panel", path: str = "path", token: int = 2) -> DataFrame:
    """The first recording, by path, of which a part of the name contains the
    code. Each part of a name is taken, so that codes are found by equality: a
    name has few, and a code in no name none."""
    name = F.lower(F.get(F.split(F.element_at(F.split(path, "/"), -1), "_"), F.lit(token)))
    starts = F.sequence(F.lit(1), F.length("_token"))
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.length("_token") - i + 1), lambda n: F.substring("_token", i, n))))
    within = audio.withColumn("_token", name).where(F.length("_token") > 0).select(path, F.explode(F.array_distinct(parts)).alias(code))
    return panels.join(within.groupBy(code).agg(F.min(path).alias(path)), code, "left")


def latest(df: DataFrame, keys: Keys, order: str) -> DataFrame:
    """Of rows with the same keys, that of the largest ``order``: a later file overrides."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def nearest_asof(events: DataFrame, samples: DataFrame, keys: Keys, t: str, event_order: str, sample_order: str, sample_t: str | None = None) -> DataFrame:
    """Each event with the ordinal of the sample nearest in time, as
    ``nearest``; of two as near, the earlier. One exchange and sort of both
    together, whatever the number of events."""
    a = samples.select(*keys, F.col(sample_t or t).alias("_t"), F.col(sample_order).alias("_i"), F.lit(0).alias("_kind"), F.lit(None).cast(events.schema[event_order].dataType).alias("_e"))
    b = events.select(*keys, F.col(t).alias("_t"), F.lit(None).cast(samples.schema[sample_order].dataType).alias("_i"), F.lit(1).alias("_kind"), F.col(event_order).alias("_e"))
    both = a.unionByName(b)
    # Of samples of one time the first: behind, it is the smallest ordinal at that time.
    first = F.min("_i").over(Window.partitionBy(*keys, "_t"))
    both = both.withColumn("_i", first)
    at = F.when(F.col("_kind") == 0, F.struct("_t", "_i"))
    back, ahead = running(keys, "_t", "_kind"), following(keys, "_t", "_kind")
    near = both.withColumns({"_b": F.last(at, True).over(back), "_f": F.first(at, True).over(ahead)}).where("_kind = 1")
    choose = F.when(F.col("_b").isNull(), F.col("_f._i")).when(F.col("_f").isNull() | (F.col("_t") - F.col("_b._t") <= F.col("_f._t") - F.col("_t")), F.col("_b._i")).otherwise(F.col("_f._i"))
    found = near.select(*keys, F.col("_e").alias(event_order), choose.alias("nearest"))
    return events.join(found, [*keys, event_order], "left")


def correlate(samples: DataFrame, events: DataFrame, keys: Keys, t: str, value: str, event_order: str, sample_order: str, name: str = "audio_event") -> DataFrame:
    """``samples`` with the value of the event nearest to each, else 0; of
    several events on one sample the last counts."""
    hit = nearest_asof(events.select(*keys, t, event_order, value), samples, keys, t, event_order, sample_order)
    one = hit.groupBy(*keys, F.col("nearest").alias(sample_order)).agg(F.max_by(value, event_order).alias(name))
    return samples.join(one, [*keys, sample_order], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def strict_before(df: DataFrame, onset: str | Column, value: str, keys: Keys, order: str, name: str) -> DataFrame:
    """The value at the last onset strictly before each row."""
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    flag = F.col(onset) if isinstance(onset, str) else onset
    return df.withColumn(name, F.last(F.when(flag, F.col(value)), True).over(w))


def segments_between(df: DataFrame, start: str | Column, keys: Keys, order: str, name: str = "segment") -> DataFrame:
    """Rows strictly between one start and the next, numbered by the start that
    follows, from 0; a segment opens at row 0, which is never in it."""
    flag = F.col(start) if isinstance(start, str) else start
    w = ordered(keys, order)
    rows = df.withColumn("_s", flag.cast("int")).withColumn("_i", F.row_number().over(w))
    before = F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_s").over(Window.partitionBy(*keys))
    return rows.withColumns({name: before, "_total": total}).where((F.col("_s") == 0) & (F.col("_i") > 1) & (F.col(name) < F.col("_total"))).drop("_s", "_i", "_total")


def targets_of(df: DataFrame, targets: DataFrame, ordinal: str, name: str = "ord", strict: bool = False) -> DataFrame:
    """The n-th utterance with the n-th target. One without a target is left
    out, or fails with ``strict``."""
    out = df.join(hinted(targets.withColumnRenamed(name, ordinal)), ordinal, "left" if strict else "inner")
    if not strict:
        return out
    column = next(c for c in targets.columns if c != name)
    return out.withColumn(column, F.coalesce(column, F.raise_error(F.lit("more utterances than targets")).cast(targets.schema[column].dataType)))


def slices(starts: DataFrame, ends: DataFrame, df: DataFrame, keys: Keys, order: str, inclusive: bool = False) -> DataFrame:
    """Rows from the n-th start to the n-th end of their series, with ``ord``."""
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    spans = pair_in_order(starts, ends, keys, order, order, "_lo", "_hi").withColumnsRenamed(names)
    on = (F.col(order) >= F.col("_lo")) & ((F.col(order) <= F.col("_hi")) if inclusive else (F.col(order) < F.col("_hi")))
    for k, n in names.items():
        on = on & (F.col(k) == F.col(n))
    return df.join(spans, on).drop("_lo", "_hi", *names.values())


def with_predictions(df: DataFrame, predictions: DataFrame, keys: Keys, t: str, value: str = "evt", window: str | None = None) -> DataFrame:
    """``value`` predicted for each sample, 0 without. Windows overlap, so a
    time may have several predictions: the last window's counts, or without
    ``window`` the most frequent one and of these the smallest."""
    by = [*keys, t]
    if window:
        one = predictions.groupBy(*by).agg(F.max_by(value, window).alias(f"{value}_pred"))
    else:
        votes = predictions.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
        one = votes.groupBy(*by).agg(F.max_by(value, F.struct("_n", -F.col(value))).alias(f"{value}_pred"))
    return df.join(one, by, "left").withColumn(f"{value}_pred", F.coalesce(f"{value}_pred", F.lit(0)))


def zip_rows(left: DataFrame, right: DataFrame, keys: Keys, order: str) -> DataFrame:
    """Rows of both that have the same place in their series."""
    return left.join(right, [*keys, order])
