"""Windows with watermarks; state is dropped once the watermark is past it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timed(df: DataFrame, t: str, late: str) -> DataFrame:
    # A timestamp without a zone has no watermark.
    return df.withColumn(t, F.col(t).cast("timestamp")).withWatermark(t, late)


def gap_sessions(df: DataFrame, t: str, keys: Sequence[str], gap: str | Column, late: str = "1 hour") -> DataFrame:
    """Sessions that ``gap`` without an event ends: bounds and number of events.
    In append mode a session comes once the watermark is past its end."""
    w = F.session_window(t, gap)
    return _timed(df, t, late).groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling_features(df: DataFrame, t: str, value: str, keys: Sequence[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count, mean and extremes of each window."""
    grouped = _timed(df, t, late).groupBy(*keys, F.window(t, width).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")).select(*keys, F.col("w.start").alias("start"), "n", "mean", "low", "high")
