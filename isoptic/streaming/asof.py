"""The nearest sample of each event, out of two streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Nearest(StatefulProcessor):
    """State of a series: samples that an event may still be nearest to, and events whose
    nearest sample isn't certain."""

    def __init__(self, key: str, idle_ms: int) -> None:
        self.key, self.idle_ms = key, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getListState("samples", "t long, i long")
        self.events = handle.getListState("events", "t long, i long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        samples, events = list(self.samples.get()), list(self.events.get())
        for part in rows:
            for kind, held in ((0, samples), (1, events)):
                of = part[part["kind"] == kind]
                held += zip(of["t"].tolist(), of["i"].tolist(), strict=True)
        yield from self._settled(key, samples, events, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._settled(key, list(self.samples.get()), list(self.events.get()), timerValues.getCurrentWatermarkInMs() * 1000)

    def _settled(self, key: tuple, samples: list, events: list, mark: int) -> Iterator[pd.DataFrame]:
        """Events whose nearest sample can't change any more: none that comes is before
        the watermark, so it is the first at or behind the event that the mark has
        passed, or the last before it once the mark is as far behind the event."""
        samples = sorted((int(t), int(i)) for t, i in samples)
        first: list[tuple[int, int]] = []  # of samples of one time that of the smallest number
        for s in samples:
            if not first or first[-1][0] != s[0]:
                first.append(s)
        out, left, at, wait = [], [], 0, []
        for t, i in sorted((int(t), int(i)) for t, i in events):
            while at < len(first) and first[at][0] <= t:
                at += 1
            before, behind = (first[at - 1] if at else None), (first[at] if at < len(first) else None)
            # Certain once the mark is past: the event itself where a sample is at its
            # time, the one behind, or as far behind the event as the one before it is.
            ends = [x for x in (behind and behind[0], before and 2 * t - before[0]) if x is not None]
            if ends and mark > max(min(ends), t):
                near = before if behind is None or before is not None and t - before[0] <= behind[0] - t else behind
                out.append((i, near[1]))
            else:
                left.append((t, i))
                wait += [max(min(ends), t)] if ends else []
        # The sample last before whatever can still come, and all later ones.
        horizon = min([mark, *(t for t, _ in left)])
        keep = next((k for k in range(len(first) - 1, -1, -1) if first[k][0] <= horizon), 0)
        self._store(first[keep:], left, wait, mark)
        if out:
            yield pd.DataFrame({self.key: [key[0]] * len(out), "event": [e for e, _ in out], "nearest": [n for _, n in out]})

    def _store(self, samples: list, events: list, wait: list[int], mark: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last = max((t for t, _ in [*samples, *events]), default=0)
        ended = mark >= last + self.idle_ms * 1000
        for state, held in ((self.samples, [] if ended else samples), (self.events, [] if ended else events)):
            state.clear()
            if held:
                state.put(held)
        if not ended and (samples or events):
            # A timer runs out once the watermark is at it: then all before are past.
            due = [last + self.idle_ms * 1000, *(w for w in wait)]
            self.handle.registerTimer(max(min(due) // 1000 + 1, mark // 1000 + 1))

    def close(self) -> None:
        pass


def nearest_asof(events: DataFrame, samples: DataFrame, key: str, t: str, event: str, sample: str, late: str = "1 hour", idle_s: float = 3600.0) -> DataFrame:
    """``key``, ``event`` and the number ``nearest`` of the sample nearest in time to it, of
    two as near the earlier, as the batch join of the same name gives them; each once no
    sample that is still to come could be nearer.

    Events and samples are two streams with the same ``key`` (a long or a string) and time
    ``t``; ``event`` and ``sample`` are their numbers. The watermark is ``late`` behind the
    stream that is less far, and rows before it are lost. A series' state is the samples since the watermark, one before them, and the
    events that wait; it ends, with what waits, once the watermark is ``idle_s`` past its last row. An
    event before any sample waits for the first. Needs a state store that lists fit in, ``PROVIDER``.
    """
    kind = events.schema[key].dataType.simpleString()
    if kind not in ("bigint", "string"):
        raise ValueError(f"a key of type {kind}: a long or a string is needed")

    def timed(df: DataFrame, number: str, kind: int) -> DataFrame:
        at = F.col(t).cast("timestamp")
        rows = df.where(at.isNotNull() & F.col(key).isNotNull())
        return rows.select(key, at.alias("ts"), F.unix_micros(at).alias("t"), F.col(number).cast("long").alias("i"), F.lit(kind).alias("kind")).withWatermark("ts", late)

    found = timed(events, event, 1).unionByName(timed(samples, sample, 0)).groupBy(key).transformWithStateInPandas(_Nearest(key, int(idle_s * 1000)), f"`{key}` {kind}, event long, nearest long", "append", "eventTime")
    return found.withColumnsRenamed({"event": event})
