"""Positions on grids: targets, heat maps, decay and blur."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..frames import Keys, ordered, whole

#: Targets that are sent to every task, at most.
TARGETS = 10_000


def target_grid(spark: SparkSession) -> DataFrame:
    """``ord`` (row by row), ``x`` and ``y`` of the target centres."""
    x = F.lit(C.GRID_LEFT) + F.col("i") * F.lit(float(C.GRID_RIGHT - C.GRID_LEFT)) / (C.GRID_COLUMNS - 1)
    y = F.lit(C.GRID_TOP) + F.col("j") * F.lit(float(C.GRID_BOTTOM - C.GRID_TOP)) / (C.GRID_ROWS - 1)
    cells = spark.range(C.GRID_COLUMNS * C.GRID_ROWS).select(F.col("id").cast("int").alias("ord"), (F.col("id") % C.GRID_COLUMNS).alias("i"), F.floor(F.col("id") / C.GRID_COLUMNS).alias("j"))
    return cells.select("ord", x.alias("x"), y.alias("y"))


def histogram_2d(df: DataFrame, x: str, y: str, width: int, height: int, keys: Keys = (), x_range: tuple[float, float] | None = None, y_range: tuple[float, float] | None = None) -> DataFrame:
    """Sparse counts (``bx``, ``by``, ``n``); the last bin of each axis is
    closed, what lies outside and NULL count nowhere."""
    (x0, x1), (y0, y1) = x_range or (0.0, float(width)), y_range or (0.0, float(height))
    bin_ = lambda c, a, b, n: F.least(F.floor((F.col(c) - a) * n / (b - a)), F.lit(n - 1)).cast("int")
    inside = df.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
    return inside.groupBy(*keys, bin_(x, x0, x1, width).alias("bx"), bin_(y, y0, y1, height).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def gaze_heatmap(df: DataFrame, x: str = "x", y: str = "y", keys: Keys = (), parity: bool = False) -> DataFrame:
    """Counts of the screen's pixels (``bx``, ``by``, ``n``) from shares of it. With ``parity`` x is
    scaled by the height, y by the width and turned upside down."""
    w, h = (C.SCREEN_HEIGHT, C.SCREEN_WIDTH) if parity else (C.SCREEN_WIDTH, C.SCREEN_HEIGHT)
    px, py = F.col(x) * w, (h - F.col(y) * h) if parity else F.col(y) * h
    return histogram_2d(df.withColumns({"_px": px, "_py": py}), "_px", "_py", w, h, keys)


def decayed_heat(df: DataFrame, bx: str, by: str, order: str, keys: Keys, decay: float = C.HEAT_DECAY, frames: int = C.HEAT_FRAMES) -> DataFrame:
    """What stays on each cell after all samples, each of which multiplies all
    by ``decay`` and then adds 1 to its own: the sum of decay ** age. ``order``
    counts from 0 without gaps; samples from ``frames`` on are left out."""
    rows = df.where(F.col(order) < frames)
    last = F.max(order).over(whole(keys))
    return rows.withColumn("_age", last - F.col(order)).where(F.col(bx).isNotNull() & F.col(by).isNotNull()).groupBy(*keys, bx, by).agg(F.sum(F.pow(F.lit(decay), F.col("_age"))).alias("heat"))


def decayed_frames(df: DataFrame, bx: str, by: str, order: str, keys: Keys, decay: float = C.HEAT_DECAY, frames: int = C.HEAT_FRAMES, block: int = 1000) -> DataFrame:
    """The heat of each cell after each frame that touches it: ``keys``, ``frame``, ``bx``,
    ``by`` and ``heat``, one row for a sample. In between a cell loses ``decay`` a frame
    (see ``heat_at``), so no other row is needed.

    A cell's frames are cut in blocks of ``block``. Within one, heats are sums of powers
    that stay in range; what earlier blocks leave is carried over as one number each, by
    a fold over the blocks' sums that has a step for each block of a cell. ``order`` counts from 0
    without gaps; samples from ``frames`` on, and those without a cell, leave none.
    """
    if not 0 < decay <= 1 or not 0 < block <= 50_000:
        raise ValueError("decay in (0, 1], a block of 1 to 50000 frames")
    cell = [*keys, bx, by]
    rows = df.where((F.col(order) < frames) & F.col(bx).isNotNull() & F.col(by).isNotNull()).select(*cell, F.col(order).cast("long").alias("frame"))
    rows = rows.withColumns({"_b": F.floor(F.col("frame") / block), "_o": F.col("frame") % block})
    weight, power = F.lit(float(decay)), lambda n: F.pow(F.lit(float(decay)), n)
    # What a block leaves at its last frame.
    ends = rows.groupBy(*cell, "_b").agg(F.sum(power(F.lit(block - 1) - F.col("_o"))).alias("_s"))
    blocks = ends.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("_b", "_s"))).alias("_all"))
    start = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0.0).alias("h"), F.array().cast("array<struct<_b:bigint,_carry:double>>").alias("out"))

    def step(s, x):
        """Heat at the last frame before block x, and then that at x's last."""
        carried = s["h"] * F.pow(weight, (x["_b"] - s["b"] - 1).cast("double") * block)
        return F.struct(x["_b"].alias("b"), (carried * F.pow(weight, F.lit(float(block))) + x["_s"]).alias("h"), F.concat(s["out"], F.array(F.struct(x["_b"].alias("_b"), carried.alias("_carry")))).alias("out"))

    folded = F.aggregate("_all", start, step, lambda s: s["out"])
    carries = blocks.select(*cell, F.explode(folded).alias("_x")).select(*cell, "_x._b", "_x._carry")
    within = ordered([*cell, "_b"], "frame").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    heat = F.sum(F.pow(weight, -F.col("_o").cast("double"))).over(within) * power(F.col("_o"))
    return rows.join(carries, [*cell, "_b"]).withColumn("heat", heat + F.col("_carry") * power(F.col("_o") + 1)).select(*keys, "frame", bx, by, "heat")


def heat_at(touched: DataFrame, at: Sequence[int], bx: str, by: str, keys: Keys, decay: float = C.HEAT_DECAY) -> DataFrame:
    """Whole frames out of ``decayed_frames``: for each of the numbers ``at`` the heat of
    every cell that was touched by then."""
    wanted = F.explode(F.filter(F.array(*[F.lit(int(n)).cast("long") for n in at]), lambda n: n >= F.col("frame")))
    last = touched.withColumn("_at", wanted).groupBy(*keys, bx, by, "_at").agg(F.max(F.struct("frame", "heat")).alias("_x"))
    return last.select(*keys, F.col("_at").alias("frame"), bx, by, (F.col("_x.heat") * F.pow(F.lit(float(decay)), F.col("_at") - F.col("_x.frame"))).alias("heat"))


def movie_frames(df: DataFrame, order: str, keys: Keys, frames: int = C.HEAT_FRAMES) -> DataFrame:
    """``df`` with the frames ``first`` to ``last`` that show each sample, when a series
    fills ``frames`` in all: each sample has the same number, one at least, and those
    from ``frames`` on are cut off. ``order`` counts from 0 without gaps."""
    n = F.count(F.lit(1)).over(whole(keys))
    each = F.greatest(F.floor(F.lit(frames) / n), F.lit(1))
    shown = df.withColumn("first", (F.col(order) * each).cast("long")).withColumn("last", F.least(F.col("first") + each, F.lit(frames)).cast("long") - 1)
    return shown.where(F.col("first") < frames)


def gaussian_kernel(sigma: float = C.BLUR_SIGMA, truncate: float = 4.0) -> list[float]:
    """Weights from -r to r that sum to 1, r = truncate * sigma rounded."""
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def gaussian_blur(cells: DataFrame, width: int, height: int, keys: Keys = (), value: str = "n", sigma: float = C.BLUR_SIGMA, truncate: float = 4.0) -> DataFrame:
    """Sparse cells blurred along each axis in turn, (2r + 1) + (2r + 1) terms a
    cell; zeros lie beyond the grid."""
    weights = gaussian_kernel(sigma, truncate)
    r = len(weights) // 2
    kernel = F.array(*[F.struct(F.lit(k - r).alias("d"), F.lit(w).alias("w")) for k, w in enumerate(weights)])
    out = cells.withColumn(value, F.col(value).cast("double"))
    for axis, size, other in (("bx", width, "by"), ("by", height, "bx")):
        spread = out.withColumn("_k", F.explode(kernel)).select(*keys, other, (F.col(axis) + F.col("_k.d")).alias(axis), (F.col(value) * F.col("_k.w")).alias(value))
        out = spread.where(F.col(axis).between(0, size - 1)).groupBy(*keys, "bx", "by").agg(F.sum(value).alias(value))
    return out


def nearest_target(df: DataFrame, targets: DataFrame, x: str, y: str, ident: list[str]) -> DataFrame:
    """The target nearest to each position; of two as near the first. Targets are few:
    more than ``TARGETS`` fail."""
    t = targets.select(F.col("ord").alias("target"), F.col("x").alias("_tx"), F.col("y").alias("_ty"))
    if t.limit(TARGETS + 1).count() > TARGETS:
        raise ValueError(f"over {TARGETS} targets")
    all_ = F.broadcast(t.agg(F.collect_list(F.struct("target", "_tx", "_ty")).alias("_all")))
    d = F.transform("_all", lambda z: F.struct(F.hypot(z["_tx"] - F.col(x), z["_ty"] - F.col(y)).alias("d"), z["target"].alias("t")))
    return df.join(all_).withColumn("_best", F.array_min(d)).select(*df.columns, F.col("_best.t").alias("target"), F.col("_best.d").alias("distance"))
