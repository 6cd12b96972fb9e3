"""``spark.read.format("npy" | "wav" | "mat")`` and ``df.write.format("npy")``.

Headers are read when a scan is planned: one file becomes as many partitions as its rows
are worth, and a task reads the bytes of its own rows. Beyond ``PIECES`` pieces neighbours
share a partition, and beyond as many files the small ones are opened by tasks alone. Conditions on ``path`` (of a MAT
file ``recording_id``) drop files and those on ``idx`` cut rows before anything is read; for
that ``register`` turns on the session's filter push-down for Python sources.

A write has two phases. Tasks write below a folder of the job; only the commit, after all
of them have succeeded, moves files to their names. A job that fails leaves nothing.

Paths are of stores that Arrow's file systems open: local, ``hdfs``, ``s3`` and ``gs``.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import chain
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..schemas import GAZE_RAW, MESSAGES
from . import mat

#: Rows of one partition, and of one batch that a task hands over.
ROWS, BATCH = 1_000_000, 100_000
#: Files whose headers are read, or that are renamed, at a time.
HEADERS = 32
#: Pieces of files up to which each is a partition; beyond, neighbours share one, of so many
#: bytes and a piece at most.
PIECES, PACKED = 256, 64 << 20
#: Of more than ``PIECES`` files, those up to so many bytes are opened by their tasks alone.
SMALL = 1 << 20
KINDS = {"f4": "float", "f8": "double", "i1": "byte", "i2": "short", "i4": "int", "i8": "long", "u1": "short", "u2": "int", "u4": "long", "b1": "boolean"}


def _system(path: str) -> tuple[pyarrow.fs.FileSystem, str, str]:
    """The file system, the path within it, and what stands before that in a URI."""
    if ":" not in path.split("/")[0]:
        return pyarrow.fs.LocalFileSystem(), path.rstrip("/") or "/", "file:"
    system, inside = pyarrow.fs.FileSystem.from_uri(path)
    local = isinstance(system, pyarrow.fs.LocalFileSystem)
    return system, inside.rstrip("/") or "/", "file:" if local else f"{path.split('://')[0]}://"


def _files(path: str, suffix: str) -> list[tuple[str, str, int]]:
    """Path, URI and size of a file, or of those below a folder, without the hidden."""
    system, inside, head = _system(path)
    [top] = system.get_file_info([inside])
    if top.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [top] if top.type == pyarrow.fs.FileType.File else system.get_file_info(pyarrow.fs.FileSelector(inside, recursive=True))
    base = len(inside)
    kept = [f for f in found if f is top or f.type == pyarrow.fs.FileType.File and f.path.lower().endswith(suffix) and not any(p[:1] in "._" for p in f.path[base:].strip("/").split("/"))]
    return sorted((f.path, head + f.path, f.size) for f in kept)


@dataclass
class Piece:
    """Rows [lo, hi) of one file; without ``hi`` those that the reader wants of it."""

    path: str
    uri: str
    lo: int
    hi: int | None
    size: int


@dataclass
class Split(InputPartition):
    """What one task reads."""

    pieces: list[Piece]


def packed(pieces: list[Piece]) -> list[Split]:
    """Partitions of neighbouring pieces, so that tasks follow bytes and not files; a piece
    each, if there are few."""
    if len(pieces) <= PIECES:
        return [Split([p]) for p in pieces]
    most = min(PACKED, sum(p.size for p in pieces) / PIECES)
    out, size = [Split([])], 0.0
    for p in pieces:
        if out[-1].pieces and size >= most:
            out.append(Split([]))
            size = 0.0
        out[-1].pieces.append(p)
        size += p.size
    return out


class _Reader(DataSourceReader):
    """Files cut into ranges of rows; conditions on the file and on the row's number are
    met by what is cut."""

    file_column, row_column = "path", "idx"

    def __init__(self, path: str, suffix: str, rows: int) -> None:
        self.path, self.suffix, self.rows = path, suffix, rows
        self.uris: set[str] | None = None
        self.lo, self.hi = 0, 2**63 - 1

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            names = {getattr(f, "attribute", None)}
            if names == {(self.file_column,)} and isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.uris = asked if self.uris is None else self.uris & asked
            elif self.row_column and names == {(self.row_column,)} and isinstance(getattr(f, "value", None), int) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.lo = max(self.lo, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.hi = min(self.hi, f.value + (not isinstance(f, LessThan)))
            else:
                yield f

    def count(self, path: str) -> int:
        raise NotImplementedError

    def partitions(self) -> list[Split]:
        files = [f for f in _files(self.path, self.suffix) if self.uris is None or f[1] in self.uris]
        opened = [f for f in files if len(files) <= PIECES or f[2] > SMALL]
        with ThreadPoolExecutor(HEADERS) as pool:
            counts = dict(zip([f[0] for f in opened], pool.map(lambda f: self.count(f[0]), opened), strict=True))
        out = []
        for path, uri, size in files:
            if path in counts:
                end = min(counts[path], self.hi)
                cuts = range(max(0, self.lo), end, self.rows)
                out += [Piece(path, uri, a, min(a + self.rows, end), size * self.rows // max(counts[path], 1)) for a in cuts]
            else:
                out.append(Piece(path, uri, max(0, self.lo), None, size))
        return packed(out) or [Split([])]

    def open(self, path: str) -> pa.NativeFile:
        return _system(self.path)[0].open_input_file(path)

    def columns(self, piece: Piece, lo: int, hi: int) -> dict[str, pa.Array | np.ndarray]:
        raise NotImplementedError

    def batches(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        end = min(self.count(piece.path), self.hi) if piece.hi is None else piece.hi
        for lo in range(piece.lo, end, BATCH):
            hi = min(lo + BATCH, end)
            cols = {"path": pa.array([piece.uri]).take(pa.array(np.zeros(hi - lo, np.int32))), "idx": pa.array(np.arange(lo, hi))}
            cols |= {k: pa.array(v) for k, v in self.columns(piece, lo, hi).items()}
            yield pa.record_batch(list(cols.values()), names=list(cols))

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in (b for p in split.pieces for b in self.batches(p)):
            if held and rows + batch.num_rows > BATCH:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()


@dataclass(frozen=True)
class NpyHeader:
    dtype: np.dtype
    shape: tuple[int, ...]
    fortran: bool
    offset: int

    @property
    def width(self) -> int:
        return self.shape[1] if len(self.shape) == 2 else 1


def npy_header(f: pa.NativeFile) -> NpyHeader:
    """What a NPY file holds, from its first bytes."""
    head = io.BytesIO(f.read(1 << 16))
    version = np.lib.format.read_magic(head)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
    if read is None:
        raise ValueError(f"NPY version {version}")
    shape, fortran, dtype = read(head, max_header_size=1 << 16)
    if dtype.hasobject or len(shape) not in (1, 2) or dtype.names and len(shape) != 1:
        raise ValueError(f"an array of shape {shape} and {dtype} is no table")
    return NpyHeader(dtype, shape, fortran, head.tell())


def npy_columns(head: NpyHeader, names: list[str] | None = None) -> list[tuple[str, str]]:
    """Names and Spark types of a file's columns."""
    fields = [(n, head.dtype[n]) for n in head.dtype.names] if head.dtype.names else [(f"c{i}", head.dtype) for i in range(head.width)]
    if names and not head.dtype.names:
        if len(names) > len(fields):
            raise ValueError(f"{len(names)} names for {len(fields)} columns")
        fields = [(n, d) for n, (_, d) in zip(names, fields, strict=False)]
    for name, d in fields:
        if d.str[1:] not in KINDS:
            raise ValueError(f"column {name} of {d}")
    return [(n, KINDS[d.str[1:]]) for n, d in fields]


class _NpyReader(_Reader):
    def __init__(self, path: str, rows: int, names: list[str] | None) -> None:
        super().__init__(path, ".npy", rows)
        self.names = names

    def header(self, path: str) -> NpyHeader:
        with self.open(path) as f:
            return npy_header(f)

    def count(self, path: str) -> int:
        return self.header(path).shape[0]

    def columns(self, piece: Piece, lo: int, hi: int) -> dict[str, np.ndarray]:
        with self.open(piece.path) as f:
            h = npy_header(f)
            kinds = npy_columns(h, self.names)
            size = h.dtype.itemsize

            def numbers(first: int, n: int) -> np.ndarray:
                f.seek(h.offset + first * size)
                raw = f.read(n * size)
                if len(raw) < n * size:
                    raise ValueError(f"{piece.uri} ends before row {hi}")
                return np.frombuffer(raw, h.dtype)

            if h.dtype.names:
                a = numbers(lo, hi - lo)
                got = [a[n] for n, _ in kinds]
            elif h.fortran and h.width > 1:
                got = [numbers(k * h.shape[0] + lo, hi - lo) for k in range(len(kinds))]
            else:
                a = numbers(lo * h.width, (hi - lo) * h.width).reshape(-1, h.width)
                got = [a[:, k] for k in range(len(kinds))]
        to = {"byte": np.int8, "short": np.int16, "int": np.int32, "long": np.int64, "float": np.float32, "double": np.float64, "boolean": bool}
        return {n: np.ascontiguousarray(x).astype(to[kind]) for (n, kind), x in zip(kinds, got, strict=True)}


@dataclass(frozen=True)
class WavHeader:
    rate: int
    channels: int
    width: int
    offset: int
    frames: int


def wav_header(f: pa.NativeFile) -> WavHeader:
    """Rate, channels, bytes of a number, and where the samples are; PCM alone."""
    riff = f.read(12)
    if riff[:4] != b"RIFF" or riff[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    kind = None
    while len(head := f.read(8)) == 8:
        name, size = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"fmt ":
            kind = struct.unpack("<HHIIHH", f.read(16))
            f.seek(f.tell() + size - 16 + size % 2)
        elif name == b"data":
            if kind is None or kind[0] not in (1, 0xFFFE) or kind[5] not in (8, 16, 24, 32):
                raise ValueError("only PCM of 8 to 32 bits")
            at = f.tell()
            frame = kind[1] * kind[5] // 8
            return WavHeader(kind[2], kind[1], kind[5] // 8, at, min(size, f.size() - at) // frame)
        else:
            f.seek(f.tell() + size + size % 2)
    raise ValueError("a WAV file without samples")


def pcm(raw: bytes, width: int) -> np.ndarray:
    """Numbers in [-1, 1)."""
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return (b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) / 2**31
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    return np.frombuffer(raw, f"<i{width}") / float(2 ** (8 * width - 1))


class _WavReader(_Reader):
    def __init__(self, path: str, rows: int) -> None:
        super().__init__(path, ".wav", rows)

    def count(self, path: str) -> int:
        with self.open(path) as f:
            return wav_header(f).frames

    def columns(self, piece: Piece, lo: int, hi: int) -> dict[str, np.ndarray]:
        with self.open(piece.path) as f:
            h = wav_header(f)
            size = h.channels * h.width
            f.seek(h.offset + lo * size)
            x = pcm(f.read((hi - lo) * size), h.width).reshape(-1, h.channels).mean(axis=1)
        return {"rate": np.full(len(x), h.rate, np.int32), "value": x}


MAT_TABLES = {"gaze": (mat.gaze_rows, GAZE_RAW), "messages": (mat.message_rows, MESSAGES), "recordings": (mat.recording_rows, mat.RECORDING)}


class _MatReader(_Reader):
    """One file is one partition: its parts are compressed as a whole."""

    file_column, row_column = "recording_id", ""

    def __init__(self, path: str, table: str, schema: StructType) -> None:
        super().__init__(path, ".mat", 1)
        self.table, self.kinds = table, schema

    def count(self, path: str) -> int:
        return 1

    def batches(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        with self.open(piece.path) as f:
            rows = MAT_TABLES[self.table][0](piece.uri, f.read())
        whole = pa.Table.from_pandas(rows, to_arrow_schema(self.kinds), preserve_index=False)  # NaN becomes null
        yield from whole.to_batches(max_chunksize=BATCH)


class _Source(DataSource):
    def option(self, name: str, default: str | None = None) -> str | None:
        return self.options.get(name, default)

    @property
    def at(self) -> str:
        path = self.option("path")
        if not path:
            raise ValueError(f"{self.name()} needs a path")
        return path

    @property
    def split_rows(self) -> int:
        rows = int(self.option("rows", str(ROWS)))
        if rows < 1:
            raise ValueError("rows of a partition: one at least")
        return rows


class NpySource(_Source):
    """``path``, ``idx`` and the fields of structured records, or the columns of an array
    (``c0``, ``c1``, ..., or those that the option ``names`` gives, comma-separated; columns
    without a name are left out). Files need the columns of the first. The option ``rows``
    is that of a partition. To write, see ``write_npy``."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    @property
    def names(self) -> list[str] | None:
        given = self.option("names")
        return [n.strip() for n in given.split(",")] if given else None

    def schema(self) -> str:
        files = _files(self.at, ".npy")
        if not files:
            raise FileNotFoundError(f"no NPY file below {self.at}")
        with _system(self.at)[0].open_input_file(files[0][0]) as f:
            columns = npy_columns(npy_header(f), self.names)
        return ", ".join(["path string", "idx long", *[f"`{n}` {k}" for n, k in columns]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _NpyReader(self.at, self.split_rows, self.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        keys = [k.strip() for k in (self.option("keys") or "").split(",") if k.strip()]
        missing = set(keys) - set(schema.names)
        if not keys or missing:
            raise ValueError(f"no keys, or without the columns {sorted(missing)}")
        existing = self.option("existing", "error")
        if existing not in ("error", "skip", "replace"):
            raise ValueError("existing: error, skip or replace")
        return _NpyWriter(self.at, keys, overwrite, existing)


class WavSource(_Source):
    """``path``, ``idx``, ``rate`` and ``value``: PCM audio at its own rate, channels
    averaged, in [-1, 1). The option ``rows`` is the frames of a partition."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return "path string, idx long, rate int, value double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _WavReader(self.at, self.split_rows)


class MatSource(_Source):
    """The option ``table`` of recordings: ``gaze`` (the default), ``messages`` or
    ``recordings``."""

    @classmethod
    def name(cls) -> str:
        return "mat"

    @property
    def table(self) -> str:
        table = self.option("table", "gaze")
        if table not in MAT_TABLES:
            raise ValueError(f"table {table}: one of {', '.join(MAT_TABLES)}")
        return table

    def schema(self) -> str:
        return MAT_TABLES[self.table][1]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _MatReader(self.at, self.table, schema)


def cut_series(batches: Iterator[pa.RecordBatch], keys: list[str], cols: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """The key and the records of each series. Rows come by key; several series of a batch
    are turned to records at once where each alone would have the same types."""
    key: tuple | None = None
    held: list[pa.RecordBatch] = []

    def records(parts: list[pa.RecordBatch]) -> np.ndarray:
        return pa.Table.from_batches(parts).to_pandas().to_records(index=False)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.ones(n, bool)
        new[1:] = False
        for k in keys:
            codes = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        at = [*np.flatnonzero(new).tolist(), n]
        rows = batch.select(cols)
        typed = all(c.null_count == 0 or pa.types.is_floating(c.type) for c in rows.columns)
        whole = records([rows]) if typed and len(at) > 3 else None
        for a, b in zip(at[:-1], at[1:], strict=True):
            own = tuple(batch.column(k)[a].as_py() for k in keys)
            if held and repr(own) != repr(key):
                yield key, records(held)
                held = []
            key = own
            if whole is not None and not held and b < n:
                yield key, whole[a:b]
            else:
                held.append(rows.slice(a, b - a))
    if held:
        yield key, records(held)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: what each is called in the job's folder, and its name."""

    files: list[tuple[str, str]]


class _NpyWriter(DataSourceArrowWriter):
    """A file for each series, named by its keys. Rows come by key, in order."""

    def __init__(self, path: str, keys: list[str], overwrite: bool, existing: str) -> None:
        self.path, self.keys, self.overwrite, self.existing = path, keys, overwrite, existing
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, folder, _ = _system(self.path)
        out: list[tuple[str, str]] = []
        done: set[tuple] = set()

        first = next(batches, None)
        if first is None:
            return Written(out)
        for key, records in cut_series(chain([first], batches), self.keys, [c for c in first.schema.names if c not in self.keys]):
            if key in done:
                raise ValueError(f"rows of {key} don't come together")
            done.add(key)
            if records.dtype.hasobject:
                raise ValueError(f"columns of {records.dtype} have no place in a NPY file")
            buffer = io.BytesIO()
            np.save(buffer, records, allow_pickle=False)
            name = "_".join(quote("" if k is None else str(k), safe=" ") for k in key) + ".npy"
            if not out:
                system.create_dir(f"{folder}/{self.job}", recursive=True)
            at = uuid.uuid4().hex
            with system.open_output_stream(f"{folder}/{self.job}/{at}") as f:
                f.write(buffer.getvalue())
            out.append((at, name))
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder, _ = _system(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = Counter(n for _, n in files)
        twice = sorted(n for n, k in names.items() if k > 1)
        selector = pyarrow.fs.FileSelector(folder, allow_not_found=True)
        there = {f.base_name: f.path for f in system.get_file_info(selector) if f.type == pyarrow.fs.FileType.File}
        clash = [] if self.overwrite or self.existing != "error" else sorted(set(names) & set(there))
        if twice or clash:
            self.abort(messages)
            raise ValueError(f"series in several tasks: {twice}" if twice else f"files are there: {clash}")
        system.create_dir(folder, recursive=True)
        if self.overwrite:
            self._each(system.delete_file, list(there.values()))
        if not self.overwrite and self.existing == "skip":
            files = [f for f in files if f[1] not in there]
        self._each(lambda f: system.move(f"{folder}/{self.job}/{f[0]}", f"{folder}/{f[1]}"), files)
        self._clear(system, folder)

    def abort(self, messages: list[Written | None]) -> None:
        system, folder, _ = _system(self.path)
        self._clear(system, folder)

    def _each(self, do: Callable, what: list) -> None:
        with ThreadPoolExecutor(HEADERS) as pool:
            for _ in pool.map(do, what):
                pass

    def _clear(self, system: pyarrow.fs.FileSystem, folder: str) -> None:
        [found] = system.get_file_info([f"{folder}/{self.job}"])
        if found.type == pyarrow.fs.FileType.Directory:
            system.delete_dir(found.path)


SOURCES = (NpySource, WavSource, MatSource)


def register(spark: SparkSession, push_filters: bool = True) -> None:
    """Make the formats known to the session."""
    for source in SOURCES:
        spark.dataSource.register(source)
    if push_filters:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_npy(df: DataFrame, path: str, keys: list[str], order: str, cols: list[str], mode: str = "append", existing: str = "error") -> None:
    """One file of records a series, named by its keys, or none at all if any task fails.
    Of files that are there already, ``append`` fails, or with ``existing`` skips or
    replaces; ``overwrite`` removes all files of the folder first. A series is one task's."""
    register(df.sparkSession, push_filters=False)
    rows = df.repartition(*keys).sortWithinPartitions(*keys, order).select(*keys, *cols)
    rows.write.format("npy").option("keys", ",".join(keys)).option("existing", existing).mode(mode).save(path)
