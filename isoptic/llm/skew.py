"""Joins that one hot key cannot slow down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side of ids may be broadcast (16 MB or so).
BROADCAST = 1_000_000
#: Parts that the rows of every key are dealt to.
SALTS = 16


def salt_of(*cols: str | Column, salts: int = SALTS) -> Column:
    """A part in [0, salts) that depends on these columns alone."""
    return F.pmod(F.xxhash64(*cols, F.lit(7919)), F.lit(salts)).cast("int")


def salted_join(rows: DataFrame, per_key: DataFrame, key: list[str], spread: list[str], how: str = "left", salts: int = SALTS, follows: bool = False) -> DataFrame:
    """Join ``rows`` (any number for a key) with ``per_key`` (one row for a key).

    ``rows`` are dealt by key and a salt made from ``spread``; ``per_key`` is
    repeated for each salt, so no task gets a whole hot key. Keys are never
    null on the ``per_key`` side; a null key in ``rows`` finds nothing. Spark takes
    ``per_key`` for as small as before it was repeated; if it ``follows`` the input it is
    never broadcast, which would go through the driver.
    """
    left = rows.withColumn("_salt", salt_of(*spread, salts=salts))
    right = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge") if follows else right, [*key, "_salt"], how).drop("_salt")


def hinted(ids: DataFrame, most: int = BROADCAST) -> DataFrame:
    """``ids`` to be broadcast if counted to be few; else they are shuffled.
    For tables that are cheap to count, with rows of a few bytes."""
    return F.broadcast(ids) if ids.count() <= most else ids


def parts_of(texts: DataFrame, least: int = 0, each: int = 32 << 20) -> int:
    """Buckets for what is made of ``text``, of about ``each`` bytes of it, so that
    one bucket's size doesn't follow the input's; as many as the session asks for
    at least."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def tasks(rows: int, each: int, least: int = 8) -> int:
    """How many tasks take ``rows``, about ``each`` a task."""
    return max(least, -(-rows // each))
