"""Exact de-duplication by skew-safe combining.

Rows are combined three times: in the map task that reads them, before any text
is shuffled, by digest and salt, and, for digests hot enough to be salted, by
digest alone. Each time the whole normalised text is
part of the grouping key, so a digest that two texts share never merges them.
After the salted step a hot text has at most ``salts`` rows, so the last step is
small however large a group of copies is; other texts move once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import SALTS, salt_of, salted_join
from .store import keep
from .text import ascii_lower

#: A digest with over one HOT-th of all rows is dealt by salts.
HOT = 10_000


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = ascii_lower,
    digest: Callable[[Column], Column] = sha256,
    salts: int = SALTS,
) -> DataFrame:
    """One row for each row of ``docs``: its id, ``digest``, ``keep_id``,
    ``group_size`` and ``kept``.

    Of equal normalised texts the row with the largest id stays. A null text
    is the empty text. A null id is smaller than any other; if all ids of a
    group are null, ``keep_id`` is null and all its rows are kept. Rows that
    repeat an id count as often as they occur, and each is kept if the id is. Other columns are ignored.
    An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("id"), normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("t")).withColumn("digest", digest(F.col("t")))
    rows = keep(base.select("id", "digest"), "digests")
    # At most ``HOT`` digests have over a HOT-th of all rows, so they may be broadcast.
    hot = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT > rows.count()).select("digest", F.lit(True).alias("hot"))
    dealt = base.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.when(F.col("hot"), salt_of("id", salts=salts)).otherwise(0))
    local = dealt.groupBy("digest", "salt", "t").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"), F.max("hot").alias("hot"))
    # What wasn't salted is whole by now: it goes on without its text, under a
    # number of its own, and only hot winners are compared again.
    winners = local.select("digest", F.when(F.col("hot"), F.col("t")).alias("t"), F.when(F.col("hot").isNull(), F.monotonically_increasing_id()).alias("single"), "keep_id", "n")
    merged = winners.repartition("digest").groupBy("digest", "t", "single").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    per_digest = keep(
        merged.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")).where("texts > 1 or group_size > 1"),
        "exact",
    )
    found = salted_join(rows, per_digest, ["digest"], ["id"], salts=salts)
    if not per_digest.where("texts > 1").isEmpty():
        # Texts that share a digest are told apart by the text itself.
        shared = per_digest.where("texts > 1").select("digest")
        groups = local.join(shared, "digest", "left_semi").groupBy("digest", "t").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
        apart = salted_join(base.join(shared, "digest", "left_semi"), groups, ["digest", "t"], ["id"], salts=salts)
        found = found.where("texts is null or texts = 1").drop("texts").unionByName(apart.select("id", "digest", "keep_id", "group_size"))
    return found.select(
        "id",
        "digest",
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), True).otherwise(F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
    )
