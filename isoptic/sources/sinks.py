"""Tables to files."""

from __future__ import annotations

import datetime
import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .datasource import cut_series


def write_records(df: DataFrame, path: str, partitions: Sequence[str] = ("participant", "panel"), mode: str = "append") -> None:
    df.write.mode(mode).partitionBy(*partitions).parquet(path)


def append_missing(df: DataFrame, path: str, keys: Sequence[str] = ("participant", "panel")) -> None:
    """Write the series that ``path`` does not hold yet. Files are ordered by the keys, and
    follow the rows' size: series have no folders of their own, unless ``path`` has those of
    ``write_records`` already."""
    spark = df.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = there.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = False
    if system.exists(there):
        folders = len(system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(there, f"{keys[0]}=*"))) > 0
        # Partition values come from the folders' names: cast to the new rows' types.
        done = spark.read.parquet(path).select(*[F.col(k).cast(df.schema[k].dataType).alias(k) for k in keys]).distinct()
        df = df.join(done, list(keys), "left_anti")
    if folders:
        write_records(df, path, keys)
    else:
        df.hint("rebalance", *keys).sortWithinPartitions(*keys).write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str, index: str | None = None) -> None:
    """With a header; with ``index`` that column comes first, without a name."""
    rest = [c for c in df.columns if c != index]
    out = df.select(F.col(index).alias(" "), *rest) if index else df
    out.write.mode("overwrite").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_npy(df: DataFrame, path: str, keys: Sequence[str], order: str, cols: Sequence[str]) -> int:
    """One NPY file of records a series, named by its keys; how many. Each is
    written under another name and then renamed. A series is one task's."""
    system, folder = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    system.create_dir(folder, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for key, records in cut_series(batches, list(keys), list(cols)):
            buffer = io.BytesIO()
            np.save(buffer, records)
            name = f"{folder}/{'_'.join(map(str, key))}.npy"
            with system.open_output_stream(f"{name}.part") as f:
                f.write(buffer.getvalue())
            system.move(f"{name}.part", name)
            n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    rows = df.select(*keys, order, *[c for c in cols if c not in (*keys, order)])
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_last(order))
    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_checkpoint(model: MLWritable, root: str, name: str, day: datetime.date | None = None) -> str:
    """A fitted model below a folder of the day; its path."""
    path = f"{root.rstrip('/')}/{(day or datetime.date.today()).isoformat()}/{name}"
    model.write().overwrite().save(path)
    return path
