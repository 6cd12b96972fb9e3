"""Ordered windows and NULL for NaN.

Every operator takes ``keys`` (what a series belongs to) and ``order`` (its
ordinal). One partition and order per pipeline keeps a chain of operators in
one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Keys = Sequence[str]


def ordered(keys: Keys, *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def whole(keys: Keys) -> WindowSpec:
    return Window.partitionBy(*keys)


def running(keys: Keys, *order: str | Column) -> WindowSpec:
    return ordered(keys, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def following(keys: Keys, *order: str | Column) -> WindowSpec:
    return ordered(keys, *order).rowsBetween(Window.currentRow, Window.unboundedFollowing)


def nan_to_null(df: DataFrame, *cols: str) -> DataFrame:
    """NaN is the largest number to Spark and poisons aggregates: at ingest it
    becomes NULL, in these columns or in all that are float or double."""
    names = cols or [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})


def with_ordinal(df: DataFrame, keys: Keys, *order: str | Column, name: str = "idx") -> DataFrame:
    """A gap-free ordinal from 0 within each series."""
    return df.withColumn(name, (F.row_number().over(ordered(keys, *order)) - 1).cast("long"))
