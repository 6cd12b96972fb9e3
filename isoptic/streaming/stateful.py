"""Operators with a state of their own for each series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(df: DataFrame, t: str | None, late: str) -> tuple[DataFrame, str]:
    if t is None:
        return df, GroupStateTimeout.NoTimeout
    # A timestamp without a zone has no watermark.
    return df.withColumn(t, F.col(t).cast("timestamp")).withWatermark(t, late), GroupStateTimeout.EventTimeTimeout


def _wait(state: GroupState, t: str | None, idle_s: float, parts: list[pd.DataFrame]) -> None:
    """Let the state end ``idle_s`` after the series' last time."""
    if t is not None:
        last = max(int(part[t].max().timestamp() * 1000) for part in parts if len(part))
        state.setTimeoutTimestamp(max(last + int(idle_s * 1000), state.getCurrentWatermarkMs() + 1))


def decayed_counts(df: DataFrame, key: str, order: str, decay: float = 0.99, t: str | None = None, idle_s: float = 3600.0, late: str = "1 hour") -> DataFrame:
    """After each micro-batch, for each key: the number of samples, each weighed
    by ``decay`` to the power of its age in samples. ``key`` is a long or a
    string; the state is two numbers. With the time ``t``, a series that the
    watermark has left ``idle_s`` behind is forgotten and would begin anew;
    without it, states stay for as many keys as ever came."""
    kind = df.schema[key].dataType.simpleString()
    rows, timeout = _timed(df.select(key, order, *([t] if t else [])), t, late)

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        heat, n = state.get if state.exists else (0.0, 0)
        parts = list(parts)
        for part in parts:
            m = len(part)
            # m samples: each older one loses m steps, the new ones 0 to m - 1.
            heat = heat * decay**m + ((1 - decay**m) / (1 - decay) if decay != 1 else m)
            n += m
        state.update((heat, n))
        _wait(state, t, idle_s, parts)
        yield pd.DataFrame({key: [k[0]], "heat": [heat], "n": [n]})

    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, heat double, n long", "heat double, n long", "update", timeout)


def run_lengths(df: DataFrame, key: str, order: str, value: str, t: str | None = None, idle_s: float = 3600.0, late: str = "1 hour") -> DataFrame:
    """Runs of equal values, each as it closes: ``value`` and ``n``. The open run
    is the state. Micro-batches are in order among themselves. With the time
    ``t``, the open run of a series that the watermark has left ``idle_s`` behind
    closes too; without it, it stays open, and its state stays."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, value)}
    rows, timeout = _timed(df.select(key, order, value, *([t] if t else [])), t, late)

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, n = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(k[0], current, n)], columns=[key, value, "n"])
            return
        parts = list(parts)
        closed = []
        for x in pd.concat(parts).sort_values(order)[value]:
            if n and x == current:
                n += 1
            else:
                if n:
                    closed.append((k[0], current, n))
                current, n = x, 1
        state.update((current, n))
        _wait(state, t, idle_s, parts)
        yield pd.DataFrame(closed, columns=[key, value, "n"])

    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {value} {kinds[value]}, n long", f"{value} {kinds[value]}, n long", "append", timeout)
