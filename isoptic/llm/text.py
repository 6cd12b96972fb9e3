"""Column expressions on text that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[^\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, with as many underscores in front as it takes to clash with no
    column, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is several times faster than ``translate``; it is taken where no
    other character of the text has a lower case.
    """
    other = text.rlike("[\\p{IsUppercase}\\p{Lt}&&[^A-Z]]")
    return F.when(other, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def word_count(text: Column) -> Column:
    """Words, runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
