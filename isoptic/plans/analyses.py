"""From recordings to labelled samples, to speech timing, to distances from
targets and to windows for models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..frames import Keys, nan_to_null, with_ordinal
from ..functions import arctangent_degrees, linear_degrees, pixels, pixels_to_cm
from ..operators import align, clean, label, segment, sequence, stats
from .registry import annotate, register

PANEL = ("participant", "task", "panel")


def clean_recording(raw: DataFrame, messages: DataFrame, recordings: DataFrame, task: str, keys: Keys = ("recording_id",)) -> DataFrame:
    """Samples of each panel, of the dominant eye, without outliers and gaps.

    Panels (``panel``, from 1) are what lies between the task's messages; one
    with too many missing samples is left out.
    """
    starts, ends = C.PANEL_MESSAGES[task]
    spans = align.panel_intervals(messages, starts, ends, keys).select(*keys, F.col("ord").alias("panel"), "lo", "hi")
    eye = clean.dominant_eye(nan_to_null(raw).join(align.hinted(recordings.select(*keys, "dom_eye")), list(keys)))
    inside = align.range_join(eye.withColumnRenamed("t_us", "t"), align.hinted(spans), keys, "t").select(*keys, "panel", "idx", "t", "x", "y")
    by = [*keys, "panel"]
    # The ordinal within the panel first: the gate then shares its exchange.
    placed = with_ordinal(inside, by, "idx", name="i").drop("idx").withColumnRenamed("i", "idx")
    return clean.clean(clean.quality_gate(placed, ["x", "y", "t"], by), ["x", "y"], by, "idx")


@register("threshold_based")
def threshold_labels(df: DataFrame, keys: Keys = PANEL, order: str = "idx", height: float = C.SCREEN_HEIGHT, width: float = C.SCREEN_WIDTH) -> DataFrame:
    """``evt`` by speed and direction of the gaze, with time from the panel's start."""
    px, py = pixels(F.col("x"), F.col("y"))
    degrees = df.withColumns({"_h": arctangent_degrees(px, width // 2), "_v": arctangent_degrees(py, height // 2)})
    return clean.rebase(label.fixations(degrees, "_h", "_v", keys, order).drop("_h", "_v"), "t", keys, order)


@register("model_based")
def model_labels(df: DataFrame, predict: Callable[[DataFrame], DataFrame] | None = None, keys: Keys = PANEL, order: str = "idx", length: int = C.SEQUENCE_LENGTH + 1, stride: int = C.STRIDE) -> DataFrame:
    """``evt_pred`` by a model of sequences: ``predict`` gets windows of samples
    (keys, ``window``, ``samples`` of t, x, y) and returns keys, ``window``,
    ``t`` and ``evt``. Recordings shorter than a window get 0."""
    if predict is None:
        raise ValueError("model_based needs predict: a function from windows to labels, with its weights")
    ready = degree_records(df, keys, order)
    windows = sequence_windows(ready, keys, order, length, stride)
    return align.with_predictions(ready, predict(windows), [*keys], "t", "evt", "window")


def degree_records(df: DataFrame, keys: Keys = PANEL, order: str = "idx") -> DataFrame:
    """Positions in degrees with the originals, validity and time from 0. What
    has degrees already passes through."""
    if "x_original" in df.columns:
        return df
    h, v = linear_degrees(F.col("x_original"), F.col("y_original"))
    named = clean.with_validity(df.withColumnsRenamed({"x": "x_original", "y": "y_original"}), "x_original")
    return clean.rebase(named.withColumns({"x": h, "y": v, "evt": F.lit(C.FIXATION)}), "t", keys, order)


def label_recording(df: DataFrame, method: str = "threshold_based", **options) -> DataFrame:
    return annotate(df, method, **options)


def sequence_windows(df: DataFrame, keys: Keys, order: str, length: int = C.SEQUENCE_LENGTH + 1, stride: int = C.STRIDE, center: bool = True) -> DataFrame:
    """Windows over the valid stretches of series, min-max scaled as a whole."""
    scaled = clean.min_max(df, ["x", "y"], keys) if center else df
    runs = label.valid_runs(scaled, "status", keys, order, length)
    by = [*keys, "run"]
    return sequence.sequences(runs, sequence.strided_windows(runs, by, order, length, stride), by, order, "t", "x", "y")


def speech_timing(events: DataFrame, participant: Keys, panel: Keys, scores: DataFrame, least: int = 25, panels: int = 6, parity: bool = False) -> DataFrame:
    """Median time between utterances for each participant with exactly
    ``panels`` panels of over ``least`` intervals, whose number of utterances
    fits the panel's score. ``scores`` has a row a panel."""
    by = [*participant, *panel]
    counted = events.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).join(scores, by)
    good = stats.ratio_gate(counted, F.floor(F.col("_rows") / 2), "strike_score").select(*by)
    gaps = segment.utterance_gaps(events.join(good, by, "left_semi"), "t", by, "t", parity)
    return stats.two_level_median(gaps, "interval", participant, panel, panels, least)


def declaration_shares(samples: DataFrame, events: DataFrame, participant: Keys, panel: Keys, order: str = "idx", more_than: int = 10, fewer_than: int = 250, parity: bool = False) -> DataFrame:
    """For each panel, means over its utterances of the share of samples in the
    key area and of fixations, where the panel's events are over ``more_than`` and
    under ``fewer_than``. ``samples`` are labelled (``evt``), with ``y`` in shares
    of the screen; of ``events``, begins open an utterance."""
    by = [*participant, *panel]
    joined = align.correlate(samples, stats.count_gate(events, by, more_than, fewer_than), by, "t", "sentence_breaks", "ord", order)
    parts = align.segments_between(joined, F.col("audio_event") == 1, by, order)
    return stats.mean_roi_shares(stats.roi_shares(parts, "y", "evt", by, "segment", order), by, "segment", parity)


def distance_from_targets(samples: DataFrame, events: DataFrame, targets: DataFrame, participant: Keys, panel: Keys, order: str = "idx", nearest_cm: float = 3.0, more_than: int = 30, parity: bool = False) -> DataFrame:
    """Mean and deviation for each participant of the distance, in centimetres,
    between the n-th target and the closest fixation before the n-th utterance.

    ``samples`` are labelled (``evt``) with x and y in shares of the screen and
    time from the panel's start; of ``events`` only begins count. Distances
    from ``nearest_cm`` on, and panels without over ``more_than`` others, are
    left out.
    """
    by = [*participant, *panel]
    recoded = samples.withColumn("evt", F.when(F.col("evt").isin(C.UNDEFINED, C.PSO), C.FIXATION).otherwise(F.col("evt")))
    px, py = pixels(F.col("x"), F.col("y"))
    joined = align.correlate(recoded.withColumns({"_x": px, "_y": py}), events, by, "t", "sentence_breaks", "ord", order)
    parts = align.segments_between(joined, F.col("audio_event") == 1, by, order)
    aimed = align.targets_of(parts, targets.withColumnsRenamed({"x": "tx", "y": "ty"}), "segment")
    found = stats.closest_run(aimed, "_x", "_y", "tx", "ty", "evt", by, "segment", order, parity)
    close = found.withColumn("cm", pixels_to_cm(F.col("distance"))).where(F.col("cm") < nearest_cm)
    return stats.mean_std(stats.count_gate(close, by, more_than=more_than), "cm", participant)
