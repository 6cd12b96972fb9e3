"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Items are a stated query set that every document is held against, in blocks of
bounded size. Every n-gram of an item is a seed, however many documents hold it.
Where seeds occur, passages with too few of the item's words to reach the
threshold are passed over, and the item is aligned with the others. No text is
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .store import small_batches

#: Words of a seed, of the items that are broadcast at a time, seeds looked at
#: together, and words of windows that are aligned together.
N, BLOCK_WORDS, SEEDS, CELLS = 3, 1_000_000, 1_000_000, 500_000
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
HITS = "doc_id long, item_id long, score double, start int, stop int"


@dataclass
class Items:
    """Seeds, sorted by hash: item's row and the seed's place in it."""

    ids: list[int]
    words: list[np.ndarray]
    hash: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @property
    def sizes(self) -> tuple[int, ...]:
        """Words of the seeds."""
        return tuple(sorted({min(N, len(x)) for x in self.words if len(x)}))


def _items(rows: list[tuple[int, str]]) -> Items:
    w = tokens.words(pa.array([t for _, t in rows], pa.string()), lower=True)
    own = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    found = [(h, i, p) for i, x in enumerate(own) if len(x) for p, h in enumerate(_grams(x, min(N, len(x))))]
    found.sort()
    h, i, p = ([x[k] for x in found] for k in range(3))
    return Items([d for d, _ in rows], own, np.array(h, np.uint64), np.array(i, np.int64), np.array(p, np.int64))


def _grams(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(x) - n + 1, np.uint64)
    for j, m in enumerate(tokens.multipliers(n)):
        out += x[j : j + len(out)] * m
    return tokens.mix64(out)


def _places(items: Items, w: tokens.Words, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(seed's row, word) of each n-gram of the texts that is a seed; all seeds
    of one hash are returned, about ``SEEDS`` at a time."""
    for n in sizes:
        h, word = tokens.grams(w, n)
        lo, hi = np.searchsorted(items.hash, h, "left"), np.searchsorted(items.hash, h, "right")
        hit = np.flatnonzero(hi > lo)
        part = np.cumsum(hi[hit] - lo[hit]) // SEEDS
        for own in np.split(hit, np.flatnonzero(np.diff(part)) + 1):
            count = hi[own] - lo[own]
            if len(own):
                yield np.repeat(lo[own] - (np.cumsum(count) - count), count) + np.arange(count.sum()), np.repeat(word[own], count)


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of one item with many windows of equal width: the best
    local score of each, and one past the last window word of that alignment."""
    b, width = windows.shape
    j = np.arange(width, dtype=np.int32)
    row, best, stop = np.zeros((b, width + 1), np.int32), np.zeros(b, np.int32), np.zeros(b, np.int32)
    for x in item:
        across = row[:, :-1] + np.where(windows == x, MATCH, MISMATCH).astype(np.int32)
        t = np.maximum(np.maximum(across, row[:, 1:] + GAP), 0)
        row[:, 1:] = np.maximum.accumulate(t - GAP * j, axis=1) + GAP * j
        at = row[:, 1:].argmax(axis=1)
        top = row[np.arange(b), at + 1]
        more = top > best
        best[more], stop[more] = top[more], at[more] + 1
    return best, stop


def _hits(items: Items, texts: pa.Array, threshold: float) -> dict[tuple, tuple]:
    """(row, item's id) to the score, start and stop of its best passage."""
    w = tokens.words(texts, lower=True)
    long, of = np.array([len(x) for x in items.words]), w.rows
    best: dict[tuple, tuple] = {}
    for seed, word in _places(items, w, items.sizes):
        rows, item = of[word], items.item[seed]
        # Where the item would begin; windows of three lengths at steps of one.
        cell = np.floor_divide(word - w.first[rows] - items.place[seed], long[item])
        jobs = np.unique(np.column_stack([item, rows, cell]), axis=0)
        for own in np.split(jobs, np.flatnonzero(np.diff(jobs[:, 0])) + 1):
            i = own[0, 0]
            some = max(1, CELLS // (3 * int(long[i]) + 2))
            for k in range(0, len(own), some):
                for row, one, score, a, b in _aligned(items.ids[i], items.words[i], own[k : k + some, 1], own[k : k + some, 2], w, threshold):
                    if (row, one) not in best or (score, -a) > (best[row, one][0], -best[row, one][1]):
                        best[row, one] = (score, a, b)
    return best


def _search(items: Items, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.pieces(batches, "text"):
            best, ids = _hits(items, batch.column("text"), threshold), batch.column("id")
            if best:
                cols = list(zip(*[(one, *v) for (_, one), v in best.items()], strict=True))
                yield pa.record_batch([ids.take(pa.array([r for r, _ in best])), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["doc_id", "item_id", "score", "start", "stop"])

    return run


def _without(items: Items, text_col: str, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.pieces(batches, text_col):
            stay = np.ones(batch.num_rows, bool)
            stay[[row for row, _ in _hits(items, batch.column(text_col), threshold)]] = False
            yield batch.filter(pa.array(stay))

    return run


def _known(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """How many words of each window the item has too."""
    own = np.unique(item)
    return (own[np.minimum(np.searchsorted(own, windows), len(own) - 1)] == windows).sum(axis=1)


def _aligned(item_id: int, x: np.ndarray, rows: np.ndarray, cell: np.ndarray, w: tokens.Words, threshold: float) -> list[tuple]:
    m = len(x)
    left = cell * m - m // 2 - 1
    at = left[:, None] + np.arange(3 * m + 2)
    first, size = w.first[rows], np.diff(w.first)[rows]
    inside = (at >= 0) & (at < size[:, None])
    windows = np.where(inside, w.hash[np.where(inside, at + first[:, None], 0)], np.uint64(0))
    # A score is at most MATCH for each word of the window that the item has.
    may = np.flatnonzero(_known(x, windows) >= threshold * m)
    if not len(may):
        return []
    windows, rows, left = windows[may], rows[may], left[may]
    score, stop = align(x, windows)
    good = np.flatnonzero(score >= threshold * MATCH * m)
    if not len(good):
        return []
    # The same alignment backwards ends where it begins.
    width = windows.shape[1]
    back = windows[good, ::-1]
    back = np.where(np.arange(width) < (width - stop[good])[:, None], np.uint64(0), back)
    _, begin = align(x[::-1], back)
    return [(int(rows[g]), item_id, score[g] / (MATCH * m), int(left[g] + width - b), int(left[g] + stop[g])) for g, b in zip(good, begin, strict=True)]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document and item of which it holds a copy: ``doc_id``,
    ``item_id``, ``score`` (share of the item's own alignment score, at least
    ``threshold``) and ``start``, ``stop``, the words of the best passage.

    Case doesn't count. A seed is an n-gram of the item, in however few or many
    documents; a passage that shares none, three words in a row, isn't found.
    Items of under three words are one seed. Null or empty texts and items match
    nothing; rows that repeat an id are searched each by itself and give one row
    a hit. Other columns are ignored; empty tables give an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = [rows.mapInArrow(tokens.tidy(_search(items, threshold)), HITS) for items in _blocks(benchmark, item_col, item_text, block_words)]
    return reduce(DataFrame.unionByName, out) if out else docs.sparkSession.createDataFrame([], HITS)


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, block_words: int) -> Iterator[Items]:
    """The items, about ``block_words`` words at a time."""
    asked = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).where(F.trim("t") != "").dropDuplicates()
    size = F.sum(F.size(F.split("t", "\\s+")))
    blocks = max(1, -(-(asked.agg(size).first()[0] or 0) // block_words))
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        items = _items(sorted(((r.i, r.t) for r in part.collect()), key=lambda x: (x[0] is not None, x)))
        if len(items.hash):
            yield items


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the rows that hold a copy of an item, as ``contaminated``
    finds them. Each row is judged by itself, so its id may be null, repeated or
    missing, and columns may have any name; empty tables drop nothing."""
    small_batches(docs.sparkSession)
    out = docs
    for items in _blocks(benchmark, item_col, item_text, block_words):
        out = out.mapInArrow(tokens.tidy(_without(items, text_col, threshold)), docs.schema)
    return out
