"""MAT files (level 5) without further libraries, and recordings from them.

Numbers, text, cells and structs are read; other classes give None. Arrays lose
their dimensions of length one, as a struct of one element loses its array.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..schemas import GAZE_RAW, MESSAGES

# Data types of elements, and classes of arrays.
_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
_MATRIX, _COMPRESSED = 14, 15
_CELL, _STRUCT, _CHAR = 1, 2, 4
_NUMBERS = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}


def _elements(data: bytes, order: str, padded: bool = True) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(f"{order}II", data, at)
        if kind >> 16:  # a small element: size, type and data in eight bytes
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size
        if padded and kind != _COMPRESSED:
            at += -size % 8


def _numbers(kind: int, raw: bytes, order: str) -> np.ndarray:
    return np.frombuffer(raw, np.dtype(_TYPES[kind]).newbyteorder(order))


def _squeezed(values: list, shape: list[int]) -> Any:
    if len(values) == 1:
        return values[0]
    out = np.empty(len(values), object)
    out[:] = values
    return out.reshape(shape, order="F").squeeze()


def _array(data: bytes, order: str) -> tuple[str, Any]:
    parts = list(_elements(data, order))
    flags = int(_numbers(*parts[0], order)[0])
    kind, shape = flags & 0xFF, [int(x) for x in _numbers(*parts[1], order)]
    name, rest = parts[2][1].decode("latin-1"), parts[3:]
    if kind in _NUMBERS:
        x = _numbers(*rest[0], order).astype(_NUMBERS[kind])
        if flags & 0x800:  # complex
            x = x + 1j * _numbers(*rest[1], order).astype(_NUMBERS[kind])
        x = x.reshape(shape, order="F").squeeze()
        return name, x.item() if x.ndim == 0 else x
    if kind == _CHAR:
        codes = rest[0][1].decode("utf-8") if rest[0][0] == 16 else "".join(map(chr, _numbers(*rest[0], order)))
        rows = shape[0] if shape else 0
        if rows <= 1:
            return name, codes
        return name, np.array(["".join(codes[i::rows]) for i in range(rows)], object)
    if kind == _CELL:
        return name, _squeezed([_array(x, order)[1] for _, x in rest], shape)
    if kind == _STRUCT:
        width = int(_numbers(*rest[0], order)[0])
        fields = [rest[1][1][i : i + width].split(b"\0")[0].decode() for i in range(0, len(rest[1][1]), width)]
        values = [_array(x, order)[1] if x else None for _, x in rest[2:]]
        n = len(fields)
        return name, _squeezed([dict(zip(fields, values[i : i + n], strict=True)) for i in range(0, len(values), n)] if n else [], shape)
    return name, None


def load(content: bytes) -> dict[str, Any]:
    """Variables by name, and the file's text as ``__header__``."""
    order = {b"IM": "<", b"MI": ">"}.get(content[126:128])
    if len(content) < 128 or order is None:
        raise ValueError("not a MAT file of level 5")
    out: dict[str, Any] = {"__header__": content[:116].decode("latin-1").rstrip("\0 ")}
    for kind, data in _elements(content[128:], order):
        if kind == _COMPRESSED:
            kind, data = next(_elements(zlib.decompress(data), order))
        if kind == _MATRIX and data:
            name, value = _array(data, order)
            out[name] = value
    return out


def _at(x: Any, path: str) -> Any:
    for k in path.split("."):
        x = x[k]
    return x


def _eye(data: dict, side: str, n: int) -> np.ndarray:
    x = np.asarray(_at(data, f"gaze.{side}.gazePoint.onDisplayArea"), float)
    if x.shape != (2, n):
        raise ValueError(f"{side} eye: shape {x.shape} for {n} samples")
    return x


def gaze_rows(path: str, content: bytes) -> pd.DataFrame:
    data = load(content)["data"]
    t = np.atleast_1d(np.asarray(_at(data, "gaze.systemTimeStamp"), float))
    left, right = (_eye(data, side, len(t)) for side in ("left", "right"))
    return pd.DataFrame({"recording_id": path, "idx": np.arange(len(t)), "t_us": t, "left_x": left[0], "left_y": left[1], "right_x": right[0], "right_y": right[1]})


def message_rows(path: str, content: bytes) -> pd.DataFrame:
    rows = load(content).get("messages")
    rows = np.atleast_2d(rows) if rows is not None else np.empty((0, 2), object)
    return pd.DataFrame({"recording_id": path, "seq": np.arange(len(rows), dtype=np.int32), "t_us": [float(x) for x in rows[:, 0]], "text": [str(x) for x in rows[:, 1]]})


def recording_rows(path: str, content: bytes) -> pd.DataFrame:
    found = load(content)
    return pd.DataFrame({"recording_id": [path], "dom_eye": [str(found.get("Dom_Eye", ""))], "header": [found["__header__"]]})


RECORDING = "recording_id string, dom_eye string, header string"


def _each(files: DataFrame, rows: Callable[[str, bytes], pd.DataFrame], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield rows(path, content)

    return files.select("path", "content").mapInPandas(run, schema)


def gaze(files: DataFrame) -> DataFrame:
    """``gaze_raw`` of a listing with contents; the recording's id is its path.
    Missing samples are NULL."""
    from ..frames import nan_to_null

    return nan_to_null(_each(files, gaze_rows, GAZE_RAW))


def messages(files: DataFrame) -> DataFrame:
    """Time and text of each message, in order."""
    return _each(files, message_rows, MESSAGES)


def recordings(files: DataFrame) -> DataFrame:
    """``recording_id``, ``dom_eye`` and ``header``."""
    return _each(files, recording_rows, RECORDING)


def panel_scores(files: DataFrame, task: str) -> DataFrame:
    """``recording_id``, ``ord`` (from 1), ``panel`` and ``strike_score``. Of an
    SDMT recording's ``task_data`` every other field, from the first, names a
    panel by its last two characters; the score has the panel's name in its
    own. KD has three panels without scores: 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                if task == "KD":
                    codes, scores = ["1", "2", "3"], [0.0] * 3
                else:
                    data = load(content).get("task_data") or {}
                    codes = [k[-2:].replace("_", "") for k in list(data)[::2]]
                    scores = [float(data[f"strikes_img_test_{k}"]) for k in codes]
                yield pd.DataFrame({"recording_id": path, "ord": np.arange(1, len(codes) + 1, dtype=np.int32), "panel": [k.lower() for k in codes], "strike_score": scores})

    return files.select("path", "content").mapInPandas(run, "recording_id string, ord int, panel string, strike_score double")
