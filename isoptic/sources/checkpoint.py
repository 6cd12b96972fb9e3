"""Weights out of PyTorch checkpoints, without PyTorch.

Both layouts are read: the ZIP package (a pickle beside one file for each storage) and the
older single stream (a pickle between headers, storages behind it). A pickle can run code,
so its opcodes are looked through first: only those that build plain values, tensors and
ordered mappings may occur, and only the names listed here may be looked up. Anything else
is refused before a byte of it is executed.
"""

from __future__ import annotations

import io
import pickle
import pickletools
import struct
import zipfile
from collections import OrderedDict
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: storages by name, and what heads the older layout.
STORAGES = {"DoubleStorage": "<f8", "FloatStorage": "<f4", "HalfStorage": "<f2", "LongStorage": "<i8", "IntStorage": "<i4", "ShortStorage": "<i2", "CharStorage": "<i1", "ByteStorage": "<u1", "BoolStorage": "|b1"}
MAGIC, PROTOCOL = 0x1950A86A20F9469CFC6C, 1001
# Opcodes that make plain values and containers, call what was looked up, or set state.
PLAIN = {
    "PROTO", "FRAME", "STOP", "MARK", "POP", "POP_MARK", "MEMOIZE", "GET", "BINGET", "LONG_BINGET", "PUT", "BINPUT", "LONG_BINPUT", "NONE", "NEWTRUE", "NEWFALSE", "INT", "BININT", "BININT1", "BININT2", "LONG",
    "LONG1", "LONG4", "FLOAT", "BINFLOAT", "STRING", "BINSTRING", "SHORT_BINSTRING", "UNICODE", "BINUNICODE", "SHORT_BINUNICODE", "BINUNICODE8", "BINBYTES", "SHORT_BINBYTES", "EMPTY_TUPLE", "TUPLE", "TUPLE1",
    "TUPLE2", "TUPLE3", "EMPTY_LIST", "LIST", "APPEND", "APPENDS", "EMPTY_DICT", "DICT", "SETITEM", "SETITEMS", "GLOBAL", "STACK_GLOBAL", "REDUCE", "BUILD", "BINPERSID", "PERSID",
}


class RefusedCheckpoint(ValueError):
    """A pickle that holds more than weights."""


@dataclass(frozen=True)
class _Storage:
    kind: str


class _Mapping(OrderedDict):
    """An ordered mapping whose attributes are not set: states carry version notes."""

    def __setstate__(self, state: Any) -> None:
        return None


def _tensor(data: np.ndarray, offset: int, shape: tuple[int, ...], strides: tuple[int, ...], *_: Any) -> np.ndarray:
    if any(x < 0 for x in (offset, *shape, *strides)) or len(shape) != len(strides):
        raise RefusedCheckpoint(f"a tensor of shape {shape} and strides {strides}")
    last = offset + sum((n - 1) * s for n, s in zip(shape, strides, strict=True)) if all(shape) else offset
    if last >= len(data) and all(shape):
        raise RefusedCheckpoint(f"a tensor of shape {shape} in a storage of {len(data)}")
    return np.lib.stride_tricks.as_strided(data[offset:], shape, [s * data.itemsize for s in strides]).copy()


def _parameter(data: Any, *_: Any) -> Any:
    return data


#: Names that may be looked up, and what stands for them.
KNOWN: dict[tuple[str, str], Any] = {("collections", "OrderedDict"): _Mapping, ("torch._utils", "_rebuild_tensor_v2"): _tensor, ("torch._utils", "_rebuild_parameter"): _parameter}
KNOWN |= {("torch", name): _Storage(kind) for name, kind in STORAGES.items()}


def _opcodes(stream: bytes) -> Iterator[tuple]:
    try:
        yield from pickletools.genops(stream)
    except ValueError as e:
        raise RefusedCheckpoint(f"no pickle: {e}") from e


def _refuse_code(stream: bytes) -> int:
    """Look through a pickle's opcodes; where the pickle ends."""
    for op, arg, at in _opcodes(stream):
        if op.name not in PLAIN:
            raise RefusedCheckpoint(f"opcode {op.name}")
        if op.name == "GLOBAL" and tuple(arg.split(" ", 1)) not in KNOWN:
            raise RefusedCheckpoint(f"name {arg}")
        if op.name == "STOP":
            return at + 1
    raise RefusedCheckpoint("a pickle without an end")


class _Plain(pickle.Unpickler):
    def __init__(self, stream: io.BytesIO, storage: Callable[..., np.ndarray]) -> None:
        super().__init__(stream)
        self.storage = storage

    def find_class(self, module: str, name: str) -> Any:
        found = KNOWN.get((module, name))
        if found is None:
            raise RefusedCheckpoint(f"name {module} {name}")
        return found

    def persistent_load(self, key: Any) -> np.ndarray:
        if not isinstance(key, tuple) or len(key) < 5 or key[0] != "storage" or not isinstance(key[1], _Storage):
            raise RefusedCheckpoint("a reference that is no storage")
        return self.storage(*key[1:5])


def _loads(stream: bytes, storage: Callable[..., np.ndarray]) -> tuple[Any, int]:
    end = _refuse_code(stream)
    try:
        return _Plain(io.BytesIO(stream[:end]), storage).load(), end
    except RefusedCheckpoint:
        raise
    except Exception as e:
        raise RefusedCheckpoint(f"a damaged pickle: {e}") from e


def _no_storage(*_: Any) -> np.ndarray:
    raise RefusedCheckpoint("a storage in a header")


def _of_package(content: bytes) -> Any:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        pickles = [n for n in z.namelist() if n.endswith("/data.pkl") or n == "data.pkl"]
        if len(pickles) != 1:
            raise RefusedCheckpoint("a package without one pickle")
        top = pickles[0].removesuffix("data.pkl")
        order = z.read(f"{top}byteorder").strip() if f"{top}byteorder" in z.namelist() else b"little"
        if order != b"little":
            raise RefusedCheckpoint(f"byte order {order!r}")

        def storage(kind: _Storage, key: str, _: Any, count: int) -> np.ndarray:
            data = np.frombuffer(z.read(f"{top}data/{key}"), kind.kind)
            if len(data) < count:
                raise RefusedCheckpoint(f"a storage of {len(data)} for {count}")
            return data[:count]

        return _loads(z.read(pickles[0]), storage)[0]


def _of_stream(content: bytes) -> Any:
    """The older layout: three pickled headers, the state, the storages' keys, and each
    storage after its length. Tensors are views of storages that come after them, so these
    are found first: the keys' order and lengths give each one's place."""
    at = 0
    for want in (MAGIC, PROTOCOL, None):
        got, n = _loads(content[at:], _no_storage)
        if want is not None and got != want:
            raise RefusedCheckpoint("neither layout of a checkpoint")
        at += n
    state = content[at:]
    seen: dict[str, tuple[str, int]] = {}

    def noted(kind: _Storage, key: str, _: Any, count: int) -> np.ndarray:
        seen[str(key)] = (kind.kind, count)
        return np.zeros(count, kind.kind)

    _, n = _loads(state, noted)
    keys, m = _loads(state[n:], _no_storage)
    at, held = n + m, {}
    for key in map(str, keys):
        kind, _ = seen[key]
        [count] = struct.unpack_from("<q", state, at)
        size = count * np.dtype(kind).itemsize
        if count < 0 or at + 8 + size > len(state):
            raise RefusedCheckpoint("a storage beyond the file's end")
        held[key] = np.frombuffer(state, kind, count, at + 8)
        at += 8 + size
    return _loads(state, lambda _, key, *__: held[str(key)])[0]


def read_state(content: bytes) -> tuple[dict[str, np.ndarray], dict[str, Any]]:
    """Weights by name, and what else the checkpoint holds (such as ``epoch``), from its
    bytes. Weights are the file's ``state_dict``, or the whole if it has none; a prefix
    that parallel training adds is taken off."""
    whole = _of_package(content) if zipfile.is_zipfile(io.BytesIO(content)) else _of_stream(content)
    if not isinstance(whole, Mapping):
        raise RefusedCheckpoint("a checkpoint that is no mapping")
    state = whole.get("state_dict", whole)
    if not isinstance(state, Mapping):
        raise RefusedCheckpoint("a state that is no mapping")
    arrays = {str(k).removeprefix("module."): v for k, v in state.items() if isinstance(v, np.ndarray)}
    if not arrays:
        raise RefusedCheckpoint("a checkpoint without weights")
    return arrays, {k: v for k, v in whole.items() if k != "state_dict" and not isinstance(v, np.ndarray)}


def load_state(spark: SparkSession, path: str) -> tuple[dict[str, np.ndarray], dict[str, Any]]:
    """``read_state`` of a file in any store that Spark reads. A missing file fails: a
    model is never run untrained."""
    found = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("content").head(2)
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} checkpoints at {path}")
    return read_state(bytes(found[0].content))
