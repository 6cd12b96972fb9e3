"""Events in sampled series: fixations, saccades, runs and their features."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..frames import Keys, ordered, running, whole
from ..functions import round_up_to_odd


def with_velocity(df: DataFrame, x: str, y: str, keys: Keys, order: str, fps: float = C.SAMPLE_RATE) -> DataFrame:
    """``speed`` (degrees a second) and ``angle`` (change of direction from the
    origin, in degrees, not wrapped around) towards the next sample."""
    w = ordered(keys, order)
    dx, dy = (F.lead(c).over(w) - F.col(c) for c in (x, y))
    direction = F.atan2(F.radians(y), F.radians(x))
    ahead = F.atan2(F.radians(F.lead(y).over(w)), F.radians(F.lead(x).over(w)))
    return df.withColumn("speed", F.hypot(dx * fps, dy * fps)).withColumn("angle", F.degrees(F.abs(ahead - direction)))


def flag_saccades(df: DataFrame, min_velocity: float = C.SACCADE_MIN_VELOCITY, max_angle: float = C.SACCADE_MAX_ANGLE, name: str = "saccade") -> DataFrame:
    """1 for samples faster than one limit that turn by less than the other."""
    return df.withColumn(name, F.coalesce(((F.col("speed") > min_velocity) & (F.col("angle") < max_angle)).cast("int"), F.lit(0)))


def forward_dwell(df: DataFrame, flag: str, keys: Keys, order: str, samples: int = int(C.MIN_FIXATION_SECONDS * C.SAMPLE_RATE), name: str = "evt") -> DataFrame:
    """Fixation where neither this sample nor the ``samples`` - 1 after it is
    flagged, fewer at the end of a series; else saccade."""
    w = ordered(keys, order).rowsBetween(0, samples - 1)
    return df.withColumn(name, F.when(F.sum(flag).over(w) == 0, C.FIXATION).otherwise(C.SACCADE))


def fixations(df: DataFrame, x: str, y: str, keys: Keys, order: str, fps: int = C.SAMPLE_RATE, smoothing_ms: float = C.SMOOTHING_MS) -> DataFrame:
    """Threshold labels of positions in degrees: smoothing, velocity, dwell."""
    from .clean import smooth

    width = int(smoothing_ms / (1000 / fps))
    smoothed = smooth(df.withColumns({"_x": F.col(x), "_y": F.col(y)}), ["_x", "_y"], keys, order, width)
    flagged = flag_saccades(with_velocity(smoothed, "_x", "_y", keys, order, fps), name="_flag")
    return forward_dwell(flagged, "_flag", keys, order, int(C.MIN_FIXATION_SECONDS * fps)).drop("_x", "_y", "speed", "angle", "_flag")


def with_runs(df: DataFrame, cols: str | Sequence[str], keys: Keys, order: str, name: str = "run") -> DataFrame:
    """A number from 0 that grows by one wherever a value changes; NULL equals NULL."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    w = ordered(keys, order)
    now, before = F.struct(*cols), F.lag(F.struct(*cols)).over(w)
    change = (before.isNotNull() & ~now.eqNullSafe(before)).cast("int")
    return df.withColumn("_change", change).withColumn(name, F.sum("_change").over(running(keys, order))).drop("_change")


def run_lengths(df: DataFrame, col: str, keys: Keys, order: str, *extra: Column) -> DataFrame:
    """One row a run: ``s`` and ``e`` (ordinals from 0, ``e`` exclusive), the
    value, and any further aggregates."""
    placed = with_runs(df, col, keys, order).withColumn("_at", F.row_number().over(ordered(keys, order)) - 1)
    return placed.groupBy(*keys, "run").agg(F.min("_at").cast("long").alias("s"), (F.max("_at") + 1).cast("long").alias("e"), F.first(col).alias(col), *extra)


def valid_runs(df: DataFrame, status: str, keys: Keys, order: str, least: int = C.SEQUENCE_LENGTH + 1) -> DataFrame:
    """Samples of unbroken valid stretches of at least ``least``, with their ``run``."""
    placed = with_runs(df, status, keys, order)
    n = F.count(F.lit(1)).over(whole([*keys, "run"]))
    return placed.withColumn("_n", n).where((F.col(status) == 1) & (F.col("_n") >= least)).drop("_n")


def onsets(df: DataFrame, col: str, keys: Keys, order: str, name: str = "onset") -> DataFrame:
    """True where the next value is larger by exactly one."""
    return df.withColumn(name, F.coalesce(F.lead(col).over(ordered(keys, order)) - F.col(col) == 1, F.lit(False)))


def sampling_rate(df: DataFrame, t: str, keys: Keys, order: str, rates: Sequence[int] = C.SAMPLE_RATES) -> DataFrame:
    """For each series the candidate nearest to the median of 1 / step; of two
    as near, the first of ``rates``. ``t`` in seconds."""
    step = df.withColumn("_d", F.col(t) - F.lag(t).over(ordered(keys, order)))
    rate = step.groupBy(*keys).agg(F.median(F.try_divide(F.lit(1.0), F.col("_d"))).alias("rate"))
    tries = F.array(*[F.struct(F.abs(F.lit(float(r)) - F.col("rate")).alias("d"), F.lit(i).alias("i"), F.lit(r).alias("fs")) for i, r in enumerate(rates)])
    return rate.withColumn("fs", F.when(F.col("rate").isNotNull(), F.array_min(tries)["fs"]))


def rolling_in_run(df: DataFrame, x: str, y: str, keys: Keys, order: str, width: int) -> DataFrame:
    """``roll_std`` and ``roll_rms`` of the ``width`` samples from each one, where
    they lie wholly within the run; NULL elsewhere. Needs ``run``."""
    by = [*keys, "run"]
    w = ordered(by, order)
    frame, steps = w.rowsBetween(0, width - 1), w.rowsBetween(0, width - 2)
    full = F.count(F.lit(1)).over(frame) == width
    d = df.withColumns({f"_d{c}": F.lead(c).over(w) - F.col(c) for c in (x, y)})
    std = F.hypot(F.stddev_pop(x).over(frame), F.stddev_pop(y).over(frame))
    rms = F.hypot(*[F.sqrt(F.avg(F.pow(f"_d{c}", 2)).over(steps)) for c in (x, y)])
    return d.withColumns({"roll_std": F.when(full, std), "roll_rms": F.when(full, rms)}).drop(f"_d{x}", f"_d{y}")


def savgol_velocity(df: DataFrame, cols: Sequence[str], keys: Keys, order: str, fps: float = C.SAMPLE_RATE, width: int = 11, name: str = "velocity") -> DataFrame:
    """Length of the Savitzky-Golay first derivative (quadratic) of ``cols``,
    times ``fps``. Within half a window of an end the quadratic of the first or
    last whole window is followed; series shorter than ``width`` give NULL."""
    half = width // 2
    w, p = ordered(keys, order), whole(keys)
    ks = range(-half, half + 1)
    s2, s4 = sum(k * k for k in ks), sum(k**4 for k in ks)
    at = lambda c, k: F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w) if k < 0 else F.col(c)
    fit = {}
    for c in cols:
        v = [at(c, k) for k in ks]
        fit[f"_b_{c}"] = sum((x * k for k, x in zip(ks, v, strict=True)), F.lit(0.0)) / s2
        fit[f"_c_{c}"] = (sum((x * (width * k * k - s2) for k, x in zip(ks, v, strict=True)), F.lit(0.0))) / (width * s4 - s2 * s2)
    fitted = df.withColumns(fit | {"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(p)})

    def slope(c: str) -> Column:
        def follow(centre: Column) -> Column:
            b, q = (F.max(F.when(F.col("_i") == centre, F.col(f"_{k}_{c}"))).over(p) for k in ("b", "c"))
            return b + 2 * q * (F.col("_i") - centre)

        return F.when(F.col("_i") < half, follow(F.lit(half))).when(F.col("_i") >= F.col("_n") - half, follow(F.col("_n") - 1 - half)).otherwise(F.col(f"_b_{c}"))

    slopes = fitted.withColumns({f"_s_{c}": slope(c) for c in cols})
    squares = sum((F.pow(f"_s_{c}", 2) for c in cols), F.lit(0.0))
    return slopes.withColumn(name, F.sqrt(squares) * fps).drop("_i", "_n", *[f"_{k}_{c}" for k in ("b", "c", "s") for c in cols])


#: Milliseconds at either end of an event that its onset and offset positions
#: are means of, for the velocity window and for data quality.
CONTEXT_MS = {0: 1, 1: 50, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 9: 1}
VELOCITY_MS, QUALITY_MS = 18, 200


def event_features(df: DataFrame, keys: Keys, order: str, fps: float = C.SAMPLE_RATE, event: str = "evt", x: str = "x", y: str = "y", context_ms: Mapping[int, float] = CONTEXT_MS, velocity_ms: float = VELOCITY_MS, quality_ms: float = QUALITY_MS) -> DataFrame:
    """One row an event: extent, duration, onset, offset, mean and median
    positions, peak velocity, amplitude, and the medians of rolling deviation
    and RMS (0 for events no longer than ``quality_ms``). Codes without a
    context have one sample."""
    width = max(3, math.ceil(velocity_ms / 1000 * fps) // 2 * 2 + 1)
    quality = int(quality_ms / 1000 * fps)
    placed = with_runs(savgol_velocity(df, [x, y], keys, order, fps, width, "_vel"), event, keys, order)
    rolled = rolling_in_run(placed, x, y, keys, order, quality)
    by = [*keys, "run"]
    w = ordered(by, order)
    context = F.lit(1)
    for code, ms in context_ms.items():
        if ms > 1:
            context = F.when(F.col(event) == code, round_up_to_odd(F.lit(ms / 1000.0 * fps), 3)).otherwise(context)
    n = F.count(F.lit(1)).over(whole(by))
    rows = rolled.withColumns({"_k": F.row_number().over(w) - 1, "_n": n, "_ws": context, "_at": F.row_number().over(ordered(keys, order)) - 1})
    early, late = F.col("_k") < F.col("_ws"), F.col("_k") >= F.col("_n") - F.col("_ws")
    out = rows.groupBy(*by).agg(
        F.min("_at").cast("long").alias("s"),
        (F.max("_at") + 1).cast("long").alias("e"),
        F.first(event).alias(event),
        *[f.alias(f"pos{a}_{k}") for a, c in (("x", x), ("y", y)) for k, f in (("s", F.avg(F.when(early, F.col(c)))), ("e", F.avg(F.when(late, F.col(c)))), ("mean", F.avg(c)), ("med", F.median(c)))],
        F.max("_vel").alias("pv"),
        F.max_by("_at", F.struct("_vel", -F.col("_at"))).cast("long").alias("pv_index"),
        *[F.when(F.first("_n") > quality, F.median(f"roll_{k}")).otherwise(0.0).alias(k) for k in ("rms", "std")],
    )
    return out.withColumns({"dur_s": F.col("e") - F.col("s"), "dur": (F.col("e") - F.col("s")) / F.lit(fps), "ampl_x": F.col("posx_e") - F.col("posx_s"), "ampl_y": F.col("posy_e") - F.col("posy_s")}).withColumn("ampl", F.hypot("ampl_x", "ampl_y"))


def recode_unknown(df: DataFrame, event: str = "evt") -> DataFrame:
    """Undefined events become fixations."""
    return df.withColumn(event, F.when(F.col(event) == C.UNDEFINED, C.FIXATION).otherwise(F.col(event)))


def only_fixations(df: DataFrame, event: str = "evt") -> DataFrame:
    return df.where(F.col(event) == C.FIXATION)


def clear_status(df: DataFrame, events: Sequence[int] = (1, 2, 3), event: str = "evt", status: str = "status") -> DataFrame:
    """Status 0 where the event is none of ``events``."""
    return df.withColumn(status, F.when(F.col(event).isin(*events), F.col(status)).otherwise(0))


def binary_events(df: DataFrame, event: str = "evt") -> DataFrame:
    """Whatever is no fixation becomes a saccade."""
    return df.withColumn(event, F.when(F.col(event) == C.FIXATION, C.FIXATION).otherwise(C.SACCADE))
