"""Line de-duplication across documents.

Normalised lines are exploded and hashed (128 bits) once, distinct documents
are counted for each hash, and the lines over the threshold are taken out by
their position in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import SALTS, salted_join
from .store import keep
from .text import SPACES, ascii_lower, unused


def line_key(line: Column) -> Column:
    """White space off both ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(SPACES)))


def repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    salts: int = SALTS,
) -> DataFrame:
    """``docs`` with ``line_text`` (the lines that stay, joined by a newline),
    ``n_lines`` and ``n_dropped``.

    A key of at least ``min_chars`` code points in at least ``min_docs``
    documents loses all its lines but those of the largest id. A null or empty
    text is one empty line. Rows that repeat an id are one document. A row
    with a null id is no document: it neither counts nor loses lines. Columns
    of any name are kept as they are, but those named above are replaced. An
    empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The text's hash tells rows apart that repeat an id with another text.
    lines = keep(
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
        .select("id", "th", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")),
        "hashed-lines",
    )
    # Pairs are made distinct first: hot keys are spread by their documents, and
    # each task then hands on one row for a key.
    pairs = lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    drops = keep(pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs).select("h1", "h2", "last"), "lines")
    gone = (
        salted_join(lines, drops, ["h1", "h2"], ["id", "pos"], how="inner", salts=salts)
        .where("id <> last")
        .groupBy("id", "th")
        .agg(F.collect_set("pos").alias("gone"))
    )
    taken = [*docs.columns, "line_text", "n_lines", "n_dropped"]
    own_th, i, th, lost = unused(taken, "own_th", "id", "th", "gone")
    gone = gone.select(F.col("id").alias(i), F.col("th").alias(th), F.col("gone").alias(lost))
    rows = docs.withColumn(own_th, F.xxhash64(text))
    joined = rows.join(gone, (F.col(id_col) == F.col(i)) & (F.col(own_th) == F.col(th)), "left")
    parts = F.split(text, "\n")
    # array_except hashes its second side, so long texts stay linear.
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(lost)), lambda p: F.get(parts, p))
    return joined.select(
        *[c for c in docs.columns if c not in ("line_text", "n_lines", "n_dropped")],
        F.when(F.col(lost).isNull(), text).otherwise(F.array_join(left, "\n")).alias("line_text"),
        F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("n_dropped"),
    )
