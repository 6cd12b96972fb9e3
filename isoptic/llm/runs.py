"""Periodic runs of words, found within what each document repeats.

A run of ``length`` words and period p repeats its first ``length - p`` words p words
on. As a run has ``least`` words and ``2 * p`` at least, that overlap is never under k
words (``overlap``), so every word of a run lies in a k-gram that its document holds
twice. All other words are masked. What survives is a few stretches, and a run lies
within one of them.

Each stretch is searched as Main and Lorentz do: it is halved again and again, and for
every middle and every period the stretch of that period over the middle is that which
agrees, forwards and backwards, with itself a period on. How far two places agree is
asked of names of blocks of words: of 1, 8, 64, ... words, equal blocks having equal
names. Agreement isn't cut at a half's ends, so what is found can't be extended.
Memory follows the longest text: 4 bytes for each surviving word and each of these sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .store import small_batches
from .text import WORD

#: Words of a run at least, beside twice its period.
LEAST = 12
#: A kept size of block is so many times the one before.
FOLD = 8
#: Pairs of places that are asked at a time.
ASKED = 1 << 20
SCHEMA = "id {id}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def overlap(least: int = LEAST) -> int:
    """The least words that a run shares with itself a period on."""
    return -(-least // 2)


def repeated(w: tokens.Words, k: int) -> np.ndarray:
    """Whether each word lies in a k-gram that its row holds twice."""
    h, at = tokens.grams(w, k)
    key = tokens.mix64(h + w.rows[at].astype(np.uint64) * tokens.multipliers(1)[0])
    order = np.argsort(key)
    twin = np.zeros(len(key), bool)
    twin[1:] = key[order[1:]] == key[order[:-1]]
    twin[:-1] |= twin[1:].copy()
    edges = np.zeros(len(w.hash) + 1, np.int64)
    found = at[order[twin]]
    np.add.at(edges, found, 1)
    np.add.at(edges, found + k, -1)
    return np.cumsum(edges)[:-1] > 0


def numbered(w: tokens.Words, at: np.ndarray) -> np.ndarray:
    """A number for each of these words, equal for equal bytes alone."""
    known: dict[bytes, int] = {}
    data = w.data.tobytes()
    spans = zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)
    return np.fromiter((known.setdefault(data[a:b], len(known)) for a, b in spans), np.int64, len(at))


def _names(x: np.ndarray, longest: int) -> list[np.ndarray]:
    """Names of the blocks of 1, FOLD, FOLD * FOLD, ... from each place of ``x``."""
    out, size, now = [x.astype(np.int32)], 1, x
    while size * FOLD <= longest:
        for _ in range(FOLD.bit_length() - 1):
            now = now - now.min()
            ahead = np.zeros(len(now), np.int64)  # a block past the end has the last word, as no other has
            ahead[: len(now) - size] = now[size:]
            now = np.unique(now * (now.max() + 1) + ahead, return_inverse=True)[1].astype(np.int64)
            size *= 2
        out.append(now.astype(np.int32))
    return out


def _agree(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """How many words from places i and j (``step`` 1), or before them (-1), agree.
    j is behind i; the last word of all agrees with none."""
    n, got = len(names[0]), np.zeros(len(i), np.int64)
    for level in range(len(names) - 1, -1, -1):
        size = FOLD**level
        open_ = np.arange(len(i))
        while len(open_):
            a, b = i[open_] + step * got[open_], j[open_] + step * got[open_]
            if step < 0:
                a, b = a - size, b - size
            ok = (a >= 0) & (b + size <= n)
            ok[ok] = names[level][a[ok]] == names[level][b[ok]]
            open_ = open_[ok]
            got[open_] += size
    return got


def _least_periods(found: np.ndarray) -> np.ndarray:
    """Of the same stretch, found with several periods, the smallest: the others are
    its multiples."""
    start, length, period = found
    found = found[:, np.lexsort((period, length, start))]
    new = np.ones(found.shape[1], bool)
    new[1:] = (found[:2, 1:] != found[:2, :-1]).any(axis=0)
    return found[:, new]


def main_lorentz(x: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start``, ``length`` and (smallest) ``period`` of all runs of the stretches
    ``x[first[s]:first[s + 1]]``, by start and then period."""
    size = np.diff(first)
    longest = int(size.max(initial=0))
    # A word of its own ends each stretch, so nothing agrees across.
    place = np.arange(len(x)) + np.repeat(np.arange(len(size)), size)
    y = np.arange(-1, -len(x) - len(size) - 1, -1)
    y[place] = x
    begin = first[:-1] + np.arange(len(size))
    names = _names(y, longest)
    found, half = np.zeros((3, 0), np.int64), 1
    while 2 * half < least:
        half *= 2
    while half < longest:
        # Middles are the odd multiples of ``half`` in each stretch; of what is
        # longest over one, the period is at most ``half``.
        count = np.where(size > half, (size - half - 1) // (2 * half) + 1, 0)
        of = np.repeat(np.arange(len(size)), count)
        middle = begin[of] + half * (2 * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) + 1)
        each = max(1, ASKED // half)
        for at in range(0, len(middle), each):
            m, s = middle[at : at + each], of[at : at + each]
            q = np.tile(np.arange(1, half + 1), len(m))
            m, s = np.repeat(m, half), np.repeat(s, half)
            lo, hi = begin[s], begin[s] + size[s]
            for i, j, inside in ((m, m + q, m + q <= hi), (m - q, m, m - q >= lo)):
                i, j, p = i[inside], j[inside], q[inside]
                some = (y[i] == y[j]) | ((i > 0) & (y[np.maximum(i - 1, 0)] == y[np.maximum(j - 1, 0)]))
                i, j, p = i[some], j[some], p[some]
                ahead, back = _agree(names, i, j, 1), _agree(names, i, j, -1)
                length = ahead + back + p
                run = length >= np.maximum(least, 2 * p)
                found = _least_periods(np.concatenate([found, np.stack([i[run] - back[run], length[run], p[run]])], axis=1))
        half *= 2
    start, length, period = found
    order = np.lexsort((period, start))
    start = start - np.searchsorted(begin, start, "right") + 1
    return start[order], length[order], period[order]


def _found(w: tokens.Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of all rows, ``start`` being a word of the whole batch."""
    covered = repeated(w, overlap(least))
    at = np.flatnonzero(covered)
    rows = w.rows[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (rows[1:] != rows[:-1])
    first = np.append(np.flatnonzero(new), len(at))
    long = np.diff(first) >= least
    at = at[np.repeat(long, np.diff(first))]
    first = np.append(0, np.cumsum(np.diff(first)[long]))
    start, length, period = main_lorentz(numbered(w, at), first, least)
    return at[start] if len(start) else start, length, period


def _kept_text(w: tokens.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of the kept words, joined by one space."""
    out = w.data.copy()
    mask = np.zeros(len(out) + 1, np.int32)
    s, e = w.start[keep], w.end[keep]
    last = np.ones(len(s), bool)  # the last kept word of its row has no space behind it
    rows = w.rows[keep]
    last[:-1] = rows[1:] != rows[:-1]
    gap = e[~last]
    out[gap] = 0x20
    np.add.at(mask, s, 1)
    np.add.at(mask, e + ~last, -1)
    inside = np.cumsum(mask)[:-1] > 0
    done = np.append(0, np.cumsum(np.where(last, e - s, e - s + 1)))
    return out[inside], done[np.searchsorted(np.flatnonzero(keep), w.first)]


def _runs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.pieces(batches, "text"):
            w = tokens.words(batch.column("text"))
            start, length, period = _found(w, least)
            dropped = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(dropped, start + period, 1)
            np.add.at(dropped, start + length, -1)
            data, off = _kept_text(w, np.cumsum(dropped)[:-1] <= 0)
            row = np.searchsorted(w.first, start, "right") - 1
            cut = np.searchsorted(row, np.arange(len(w.first)))
            structs = pa.StructArray.from_arrays([pa.array(start - w.first[row]), pa.array(length), pa.array(period)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), structs)
            text = pa.LargeStringArray.from_buffers(batch.num_rows, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
            yield pa.record_batch([batch.column("id"), pa.array(np.diff(w.first)), lists, text], names=["id", "n_words", "runs", "collapsed"])

    return tokens.tidy(run)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row for each row of ``docs``: its ``id``, ``n_words``, ``runs`` (by start,
    then period) and ``collapsed``, its words without those that a run holds after its
    first period, joined by one space.

    A run is a stretch of words with smallest period q, of ``least`` words and ``2 * q``
    at least, that neither neighbour extends. Words are runs of anything but ASCII
    white space, unchanged. A null or empty text, or one of white space, has no words,
    no runs and an empty ``collapsed``. Runs can overlap; a word that any of them holds
    after its first period goes. Rows are judged by themselves, so ids can be null or
    repeat. Other columns are ignored, whatever their names. An empty table gives an
    empty result.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_runs(least), SCHEMA.format(id=rows.schema["id"].dataType.simpleString()))


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the ``text`` of a test: in one of ten documents, by a hash of the id,
    all words from a place on become the first of them over and over. Others, those
    without an id and those without words are unchanged."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))).alias("words"))
    own = own.withColumn("n", F.size("words").cast("long"))
    own = own.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    part = F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1
    cycle = F.slice("words", (F.col("a") + 1).cast("int"), part.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil((F.col("n") - F.col("a")) / part).cast("int"))), F.lit(1), (F.col("n") - F.col("a")).cast("int"))
    new = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), tail), " ")
    return own.select("id", F.when(F.col("a").isNotNull(), new).otherwise(F.col("text")).alias("text"))
