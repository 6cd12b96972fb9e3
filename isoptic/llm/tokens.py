"""Words of an Arrow string column as 64-bit hashes, without a Python loop over rows."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def multipliers(n: int) -> np.ndarray:
    """n odd numbers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * _ODD) | np.uint64(1)


@dataclass
class Words:
    """``hash[first[d]:first[d + 1]]`` are the words of row d; ``start`` and
    ``end`` are their bytes in ``data``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans up to 8 bytes never collide
    with spans of the same length."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    out = mix64((eight[start] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _ODD)
    left, at = np.flatnonzero(size > 8), 8
    while len(left):
        part = eight[start[left] + at] & _MASK[np.minimum(size[left] - at, 8)]
        out[left] = mix64(out[left] * np.uint64(0xD6E8FEB86659FD93) + part)
        at += 8
        left = left[size[left] > at]
    return out


def words(texts: pa.Array, lower: bool = False) -> Words:
    """The words of each row: runs of anything but ASCII white space."""
    data, off = buffers(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(off), np.int64), np.zeros(0, np.uint64))
    gap = SPACE[data]
    edge = np.empty(n + 1, bool)  # a word can't go on across this byte
    edge[0] = True
    edge[1:] = gap
    edge[off[:-1][off[:-1] < n]] = True
    start = np.flatnonzero(~gap & edge[:n])
    stop = np.empty(n, bool)
    stop[:-1] = gap[1:]
    stop[-1] = True
    stop[off[1:][off[1:] > 0] - 1] = True
    end = np.flatnonzero(~gap & stop) + 1
    return Words(data, start, end, np.searchsorted(start, off), hash_spans(data, start, end))


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words of a row, and the first word of each."""
    n = len(w.hash)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = np.ones(n - k + 1, bool)
    for cut in range(1, k):  # no gram that begins up to k - 1 words before a row's end
        at = w.first[1:] - cut
        at = at[(at >= w.first[:-1]) & (at <= n - k)]
        whole[at] = False
    at = np.flatnonzero(whole)
    out = np.zeros(len(at), np.uint64)
    for j, m in enumerate(multipliers(k)):
        out += w.hash[at + j] * m
    return mix64(out), at


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of text, one row at least,
    so that memory follows the longest text and not the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        off = np.cumsum(np.diff(buffers(batch.column(column))[1]))
        at = 0
        while at < batch.num_rows:
            base = off[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(off, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which a worker gives freed memory back:
    it stays for the next task, beside the JVM that needs it by then."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library, which has no such call

    return tidied
