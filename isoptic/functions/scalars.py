"""Small expressions on numbers and arrays."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_up_to_odd(x: Column, least: int = 3) -> Column:
    """The ceiling, made odd by adding one where it is even."""
    return F.greatest(F.floor(F.ceil(x) / 2) * 2 + 1, F.lit(least)).cast("long")


def human_format(x: Column, suffixes: tuple[str, ...] = ("", "K", "M", "G", "T", "P")) -> Column:
    """1234567 as 1.235M: three digits after the point, a suffix for every 1000 that
    the number reaches."""
    power = sum((F.abs(x) >= F.lit(1000.0**k)).cast("int") for k in range(1, len(suffixes)))
    return F.concat(F.format_string("%.3f", (x / F.pow(F.lit(1000.0), power)).cast("double")), F.get(F.array(*[F.lit(s) for s in suffixes]), power))


def one_hot(x: Column, classes: int) -> Column:
    """An array of ``classes`` zeros with a 1 at ``x``."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == x).cast("int"))


def recode(x: Column, codes: Mapping[int, int], other: int | None = None) -> Column:
    """Codes replaced; the rest are kept, or all become ``other``."""
    out = F.lit(None).cast("int")
    for a, b in codes.items():
        out = F.when(x == a, b).otherwise(out)
    rest = x if other is None else F.when(x.isNotNull(), F.lit(other))
    return F.when(x.isin(*codes), out).otherwise(rest)


def box_muller(u: Column, v: Column) -> Column:
    """A standard normal from two uniforms; infinite where the first is 0."""
    log = F.when(u == 0, F.lit(float("-inf"))).otherwise(F.ln(u))
    return F.sqrt(-2 * log) * F.cos(2 * F.lit(3.141592653589793) * v)


def scaled_noise(level: Column, seed: int) -> Column:
    """Seeded normal noise of standard deviation level / 2."""
    return F.randn(seed) * level / 2


def shifted_labels(events: Column) -> Column:
    """Labels from 0 of every sample but the first."""
    return F.transform(F.slice(events, F.lit(2), F.greatest(F.size(events) - 1, F.lit(0))), lambda e: e - 1)
