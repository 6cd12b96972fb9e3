"""Files to tables.

Files are listed and read by Spark, so they may lie in any store that it reads;
Python only decodes bytes. Of a listing no contents are read.
"""

from __future__ import annotations

import io
import json
import struct
import wave
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..schemas import FIXATION, TRAINING_RECORD

#: Samples of decoded files in one batch, and files.
CHUNK, FILES = 500_000, 500


def listed(spark: SparkSession, path: str, glob: str = "*", contains: str | None = None, contents: bool = False) -> DataFrame:
    """``path``, ``name`` and ``length`` of files at any depth below ``path``;
    with ``contains`` only those whose lower-cased name has it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    found = found.withColumn("name", F.element_at(F.split("path", "/"), -1))
    if contains is not None:
        found = found.where(F.lower("name").contains(contains))
    return found.select("path", "name", "length", *(["content"] if contents else []))


def allowed(files: DataFrame, names: Sequence[str], name: str = "name") -> DataFrame:
    """Files whose name up to the first underscore is one of ``names``."""
    return files.where(F.split(name, "_")[0].isin(*names))


def directories(files: DataFrame, root: str, task: str) -> DataFrame:
    """Distinct ``grp`` and ``participant`` of files below root/grp/participant/task."""
    rest = F.regexp_extract("path", rf"{root.rstrip('/')}/([^/]+)/([^/]+)/{task}/", 1), F.regexp_extract("path", rf"{root.rstrip('/')}/([^/]+)/([^/]+)/{task}/", 2)
    return files.select(rest[0].alias("grp"), rest[1].alias("participant")).where("grp <> ''").distinct()


def recording_date(header: Column, default: str = C.DEFAULT_RECORDING_DATE) -> Column:
    """The date in a MAT header ("... Created on: Mon Jul 15 10:11:12 2024"),
    or the default."""
    text = F.regexp_extract(header, r"Created on:\s*\w{3}\s+(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\d{4})", 1)
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(text, r"\s+", " "), F.lit("MMM d HH:mm:ss yyyy")), F.to_timestamp(F.lit(default)))


def _decoded(files: DataFrame, decode: Callable[[bytes], pd.DataFrame], schema: str) -> DataFrame:
    """``path`` and the columns of ``schema``, in chunks of a file's rows or of several
    short files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = decode(content)
                rows.insert(0, "path", path)
                for k in range(0, len(rows), CHUNK):
                    part = rows.iloc[k : k + CHUNK]
                    if size + len(part) > CHUNK or len(held) >= FILES:
                        yield pd.concat(held)
                        held, size = [], 0
                    held.append(part)
                    size += len(part)
        if held:
            yield pd.concat(held)

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}")


def _wave(content: bytes) -> tuple[int, np.ndarray]:
    with wave.open(io.BytesIO(content)) as w:
        rate, channels, width, n = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()
        raw = w.readframes(n)
    if width == 3:
        bytes_ = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = (bytes_[:, 0].astype(np.int32) << 8 | bytes_[:, 1].astype(np.int32) << 16 | bytes_[:, 2].astype(np.int32) << 24) / 2**31
    elif width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    else:
        x = np.frombuffer(raw, f"<i{width}") / float(2 ** (8 * width - 1))
    return rate, x.reshape(-1, channels).mean(axis=1)


def wav_samples(files: DataFrame) -> DataFrame:
    """``path``, ``rate``, ``idx`` and ``value``: PCM audio at its own rate,
    channels averaged, in [-1, 1). From a listing with contents."""

    def decode(content: bytes) -> pd.DataFrame:
        rate, x = _wave(content)
        return pd.DataFrame({"rate": np.full(len(x), rate, np.int32), "idx": np.arange(len(x), dtype=np.int64), "value": x})

    return _decoded(files, decode, "rate int, idx long, value double")


def wav_info(files: DataFrame) -> DataFrame:
    """``path``, ``rate``, ``channels`` and ``samples``."""

    def decode(content: bytes) -> pd.DataFrame:
        with wave.open(io.BytesIO(content)) as w:
            return pd.DataFrame({"rate": np.array([w.getframerate()], np.int32), "channels": np.array([w.getnchannels()], np.int32), "samples": np.array([w.getnframes()], np.int64)})

    return _decoded(files, decode, "rate int, channels int, samples long")


NAMES = ("t", "x", "y", "status", "evt")


def _records(content: bytes) -> pd.DataFrame:
    """Structured records with the five names, or an array with those columns
    in that order."""
    a = np.load(io.BytesIO(content), allow_pickle=False)
    if a.dtype.names:
        missing = set(NAMES) - set(a.dtype.names)
        if missing:
            raise ValueError(f"records without {sorted(missing)}")
        cols = {k: a[k] for k in NAMES}
    else:
        if a.ndim != 2 or a.shape[1] < len(NAMES):
            raise ValueError(f"an array of shape {a.shape} has no {len(NAMES)} columns")
        cols = {k: a[:, i] for i, k in enumerate(NAMES)}
    types = {"t": np.float64, "x": np.float32, "y": np.float32, "status": np.int16, "evt": np.int16}
    return pd.DataFrame({"idx": np.arange(len(a), dtype=np.int64)} | {k: np.asarray(v, np.float64).astype(types[k]) for k, v in cols.items()})


def npy_records(files: DataFrame, events: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``path``, ``idx`` and training records; undefined events are fixations,
    status is 0 where the event is none of ``events``. NaN becomes NULL."""
    from ..frames import nan_to_null
    from ..operators.label import clear_status, recode_unknown

    rows = nan_to_null(_decoded(files, _records, f"idx long, {TRAINING_RECORD}"), "t", "x", "y")
    return clear_status(recode_unknown(rows), events)


def fixation_csv(spark: SparkSession, path: str) -> DataFrame:
    """The columns of a fixation file with a header; an index column is ignored."""
    header = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    wanted = [x.split()[0] for x in FIXATION.split(", ")]
    return header.select(*[F.col(c).cast("double").alias(c) for c in wanted])


def fixations(spark: SparkSession, path: str) -> DataFrame:
    """A fixation file by its suffix: CSV as it is, NPY with binary events."""
    from ..operators.label import binary_events

    if path.endswith(".csv"):
        return fixation_csv(spark, path)
    rows = _decoded(spark.read.format("binaryFile").load(path).select("path", "content"), _records, f"idx long, {TRAINING_RECORD}")
    return binary_events(rows).select("t", F.col("x").cast("double").alias("eye_horizontal"), F.col("y").cast("double").alias("eye_vertical"), F.col("status").cast("double").alias("status"), F.col("evt").cast("double").alias("evt"))


def parsed(spark: SparkSession, source: str | np.ndarray | DataFrame, parse: Callable[[bytes], pd.DataFrame] | None = None, schema: str = TRAINING_RECORD) -> DataFrame:
    """Records from a path (NPY, or bytes that ``parse`` turns into rows of
    ``schema``, such as those of a MAT reader), an array, or a table."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, np.ndarray):
        buffer = io.BytesIO()
        np.save(buffer, source)
        return spark.createDataFrame(_records(buffer.getvalue()), f"idx long, {TRAINING_RECORD}")
    files = spark.read.format("binaryFile").load(source).select("path", "content")
    return _decoded(files, parse or _records, schema if parse else f"idx long, {TRAINING_RECORD}")


def _shape(content: bytes) -> tuple[int, int]:
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        width, height = struct.unpack(">II", content[16:24])
        return height, width
    if content[:2] != b"\xff\xd8":
        raise ValueError("neither PNG nor JPEG")
    at = 2
    while at + 9 < len(content):
        if content[at] != 0xFF:
            raise ValueError("damaged JPEG")
        kind = content[at + 1]
        if kind == 0xFF:
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return struct.unpack(">HH", content[at + 5 : at + 9])
        else:
            at += 2 + struct.unpack(">H", content[at + 2 : at + 4])[0]
    raise ValueError("JPEG without a frame")


def image_shapes(files: DataFrame) -> DataFrame:
    """``path``, ``height`` and ``width`` of PNG and JPEG files, by their headers."""

    def decode(content: bytes) -> pd.DataFrame:
        h, w = _shape(content)
        return pd.DataFrame({"height": np.array([h], np.int32), "width": np.array([w], np.int32)})

    return _decoded(files, decode, "height int, width int")


def config(path: str, **over) -> dict:
    """A JSON file's values under those given here; ``center_data`` and
    ``stride_step`` have defaults."""
    with open(path) as f:
        return {"center_data": True, "stride_step": C.STRIDE} | json.load(f) | over
