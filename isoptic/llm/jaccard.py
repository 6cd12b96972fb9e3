"""Self-join of documents by the Jaccard similarity of their word n-grams.

Equal sets are one class. Classes are joined by prefix filtering: the rarest
part of each set is indexed, and set relations skip most of the rest, in two ways.

An index list stands in blocks of about one size, each ordered by position. Two
entries can only be of linked sets if their positions are about as far from the
front, so an entry is held against one range of a block, found by bisection, and
what lies before and behind it is skipped without being looked at.

Sets that are linked already need no more links with each other, and a set that is
much like another gets its answers from it. In a few rounds each set is held
against one other of its lists, a pivot or a neighbour, and links make components.
Where a component has many entries in a list, its first set alone is compared with
every set there, members and others. A member's answer follows from the first
set's by the n-grams in which the two differ: at most so many more, or fewer, are
shared. Members are ordered by that difference, and only those for which it
leaves the answer open are paired with the other set. A first set with very many
answers has them dealt in blocks by size, of which any two are one task's: no list
needs to hold them, and each pair is settled once.

Pairs are then counted over all lists, and those whose shared prefix is too small
for the threshold are dropped unread. What remains is compared in full, by blocks of
sets, as long as the two are not connected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import tokens
from .components import components
from .skew import hinted, parts_of, salted_join, tasks
from .store import discard, keep, small_batches
from .text import unused

#: The threshold is NUM / DEN.
NUM, DEN, WORDS = 3, 4, 5
#: Most frequent n-grams that are put last in every set, at most.
FREQUENT = 1 << 20
#: n-grams are counted by half their hash, and only those whose hash is in the
#: lower part of its range: no other gets into a prefix, but of small sets.
COUNTED = np.uint64(int(0.4 * 2**64))
#: Index entries that one bucket holds, about, pairs that are made at a time, and
#: sets up to which all pairs of a list are made at once.
BUCKET, PAIRS, SHORT = 400_000, 100_000, 8
#: Entries of a component in a list from which its first set answers for it.
HEAVY = 32
#: Buckets at least: more than a few, so that what is sent is packed alike
#: whatever the input's size.
PARTS = 64
#: Rounds in which sets are connected one by one before all pairs are made.
ROUNDS = 3
#: Sets of a block of a family.
BLOCK = 256
#: Answers of a first set that go with the lists, at most, and of a block of more; bytes
#: of a block, about; and pairs of a task that are settled at a time.
MANY, SIDE, SIDE_BYTES, SETTLED = 128, 512, 8 << 20, 1 << 16
#: Bytes of the bits that tell how sets differ from a first one, beyond which they are
#: lists, and of those that are held against each other at a time.
BITS, CHUNK = 16 << 20, 1 << 20
#: Rows up to which one side of a semi-join is broadcast.
BROADCAST = 1_000_000
#: Bands of size that a set's partners lie in, below and above its own.
BANDS = 4
ENTRY = np.dtype([("v", "<u8"), ("s", "<i8"), ("n", "<u4"), ("p", "<u4")])


def _sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct n-grams of each text; all words of a shorter one."""
    w = tokens.words(texts, lower=True)
    h, at = tokens.grams(w, words)
    cut = np.searchsorted(at, w.first)
    out = [np.unique(h[a:b]) if b > a else h[:0] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    size = np.diff(w.first)
    odd = tokens.multipliers(words + 1)
    for d in np.flatnonzero((size > 0) & (size < words)):
        own = w.hash[w.first[d] : w.first[d + 1]]
        out[d] = tokens.mix64((own * odd[: len(own)]).sum(keepdims=True) + odd[-1:] * np.uint64(len(own)))
    return out


def _name(x: np.ndarray) -> int:
    """A 64-bit name of a set."""
    m = tokens.multipliers(3)
    both = tokens.mix64(x).sum(keepdims=True) * m[0] + tokens.mix64(x ^ m[1]).sum(keepdims=True) + m[2:] * np.uint64(len(x))
    return int(tokens.mix64(both).view(np.int64)[0])


def _need(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest intersection of a link, from the sets' sizes."""
    return -(-NUM * (a.astype(np.int64) + b) // (NUM + DEN))


def _prefix(n: np.ndarray) -> np.ndarray:
    return n - -(-NUM * n // DEN) + 1


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c) for c in columns], names=names)


# First scan: names, sizes and frequent n-grams.


def _names(words: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size = [], 0
        names = ["bucket", "blob", "id", "s", "n"]

        def flush() -> Iterator[pa.RecordBatch]:
            """Each n-gram with its count, in the tasks that count it in all."""
            if pending:
                h, n = np.unique(np.concatenate(pending), return_counts=True)
                b = (h % np.uint32(buckets)).astype(np.int64)
                order = np.argsort(b, kind="stable")
                cut = np.searchsorted(b[order], np.arange(buckets + 1)).tolist()
                e = np.empty(len(h), COUNT)
                e["h"], e["n"] = h[order], np.minimum(n[order], np.iinfo(np.uint16).max)
                got = [(i, e[x:y].tobytes()) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
                for k in range(0, len(got), 64):
                    part = got[k : k + 64]
                    none = pa.nulls(len(part), pa.int64())
                    yield pa.record_batch([pa.array([x for x, _ in part], pa.int64()), pa.array([y for _, y in part], pa.binary()), none, none, none], names=names)
                pending.clear()

        for batch in tokens.pieces(batches, "text"):
            sets = _sets(batch.column("text"), words)
            n = np.array([len(x) for x in sets], np.int64)
            none = len(n)
            yield pa.record_batch([pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary()), batch.column("id"), pa.array([_name(x) if len(x) else None for x in sets], pa.int64()), pa.array(n)], names=names)
            low = [(x[: int(np.searchsorted(x, COUNTED))] >> np.uint64(32)).astype(np.uint32) for x in sets]
            pending += low
            size += sum(map(len, low))
            if size > 500_000:
                yield from flush()
                size = 0
        yield from flush()

    return run


NAMES = "bucket long, blob binary, id long, s long, n long"
COUNT = np.dtype([("h", "<u4"), ("n", "<u2")])


def _frequent(most: int):
    """A task's n-grams that more sets have than a short list holds; of these
    the ``most`` most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(x, COUNT) for batch in batches for x in batch.column("blob").to_pylist()]
        if not parts:
            return
        e = np.concatenate(parts)
        h, back = np.unique(e["h"], return_inverse=True)
        n = np.bincount(back, e["n"]).astype(np.int64)
        often = np.flatnonzero(n > SHORT)
        often = often[np.argsort(-n[often], kind="stable")][:most]
        yield _batch(["h", "n"], h[often].astype(np.int64), n[often])

    return run


# Second scan: the prefixes, by bucket.


def _order(x: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set in the order that all sets share: by hash, the frequent last, by
    their rank."""
    if not len(frequent):
        return x >> np.uint64(1)
    half = (x >> np.uint64(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(frequent, half), len(frequent) - 1)
    last = np.uint64(1 << 63) | rank[at] << np.uint64(42) | x & np.uint64((1 << 42) - 1)
    return np.sort(np.where(frequent[at] == half, last, x >> np.uint64(1)))


def _prefixes(words: int, buckets: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        held: list[np.ndarray] = []
        common, rank = frequent.value

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                all_ = np.concatenate(held)
                b = (tokens.mix64(all_["v"]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(b, kind="stable")
                cut = np.searchsorted(b[order], np.arange(buckets + 1))
                got = [(i, all_[order[x:y]].tobytes()) for i, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if y > x]
                for k in range(0, len(got), 64):
                    yield _batch(["bucket", "blob"], [x for x, _ in got[k : k + 64]], [y for _, y in got[k : k + 64]])
                held.clear()

        size = 0
        for batch in tokens.pieces(batches, "text"):
            for x in _sets(batch.column("text"), words):
                if not len(x) or (s := _name(x)) in done:
                    continue
                done.add(s)  # copies within a task are indexed once
                n = len(x)
                p = int(_prefix(np.int64(n)))
                e = np.empty(p, ENTRY)
                e["v"], e["s"], e["n"], e["p"] = _order(x, common, rank)[:p], s, n, np.arange(p)
                held.append(e)
                size += p
            if size > 200_000:
                yield from flush()
                size = 0
        yield from flush()

    return run


# Index lists.


def _band(n: np.ndarray) -> np.ndarray:
    """Sizes that differ by a ninth or so are one band."""
    return (np.log2(n) * 8).astype(np.int64)


def _lists(blobs: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Entries of lists with two sets at least, by list, band and position, and
    where each list begins (and the last ends)."""
    parts = [np.frombuffer(b, ENTRY) for b in blobs]
    e = np.concatenate(parts) if parts else np.zeros(0, ENTRY)
    order = np.argsort(e["v"])
    v = e["v"][order]
    twin = np.zeros(len(v), bool)
    twin[1:] = v[1:] == v[:-1]
    twin[:-1] |= twin[1:].copy()
    e = e[order[twin]]
    e = e[np.lexsort((e["s"], e["p"], _band(e["n"]), e["v"]))]
    if len(e):
        again = np.zeros(len(e), bool)
        again[1:] = (e["v"][1:] == e["v"][:-1]) & (e["s"][1:] == e["s"][:-1])
        e = e[~again]
        e = e[np.repeat(np.diff(_firsts(e["v"])), np.diff(_firsts(e["v"]))) > 1]
    return e, _firsts(e["v"])


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins (and the last ends)."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.append(np.flatnonzero(new), len(new))


def _ranges(lo: np.ndarray, hi: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each place of the ranges [lo, hi) with what the range is ``of``, about
    ``PAIRS`` at a time."""
    some = np.flatnonzero(hi > lo)
    lo, hi, of = lo[some], hi[some], of[some]
    ends, at = np.cumsum(hi - lo), 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        c = hi[at:to] - lo[at:to]
        yield np.repeat(lo[at:to] - (np.cumsum(c) - c), c) + np.arange(c.sum()), np.repeat(of[at:to], c)
        at = to


def _block_pairs(e: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of one list, each once, that positions and sizes allow:
    of a block only the range of positions that can reach the threshold."""
    if not len(e):
        return
    list_of, band = np.repeat(np.arange(len(first) - 1), np.diff(first)), _band(e["n"])
    start = _firsts(list_of, band)
    begin = start[:-1]
    key = list_of[begin] * 1024 + band[begin]
    least, most = (f.reduceat(e["n"].astype(np.int64), begin) for f in (np.minimum, np.maximum))
    block = np.repeat(np.arange(len(begin)), np.diff(start))
    place = block << 32 | e["p"].astype(np.int64)
    n, p, j = e["n"].astype(np.int64), e["p"].astype(np.int64), np.arange(len(e))
    for down in range(BANDS + 1):
        asked = list_of * 1024 + band - down
        b = np.minimum(np.searchsorted(key, asked), len(key) - 1)
        ok = np.flatnonzero(key[b] == asked)
        b, m, q = b[ok], n[ok], p[ok]
        before, behind = m - _need(m, least[b]), most[b] - _need(m, most[b])
        ok, b, q, before, behind = (x[(before >= 0) & (behind >= 0)] for x in (ok, b, q, before, behind))
        lo = np.searchsorted(place, b << 32 | np.maximum(q - before, 0), "left")
        hi = np.searchsorted(place, b << 32 | q + behind, "right")
        if not down:
            hi = np.minimum(hi, j[ok])
        yield from _ranges(lo, hi, ok)


def _may(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two entries of a list can be of linked sets, by size and position."""
    n, m, p, q = (z.astype(np.int64) for z in (x["n"], y["n"], x["p"], y["p"]))
    most = np.minimum(p, q) + np.minimum(n - p, m - q)
    return (most >= _need(n, m)) & (x["s"] != y["s"])


def _counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each pair of entries' sets once, the smaller name first, with how often."""
    turn = a["s"] > b["s"]
    x, y = np.where(turn, b, a), np.where(turn, a, b)
    m = tokens.multipliers(2)
    key = tokens.mix64(x["s"].view(np.uint64) * m[0] + y["s"].view(np.uint64) * m[1]) if len(x) else np.zeros(0, np.uint64)
    _, at, c = np.unique(key, return_index=True, return_counts=True)
    x, y = x[at], y[at]
    return x["s"].copy(), y["s"].copy(), x["n"].astype(np.int64), y["n"].astype(np.int64), c.astype(np.int64)


FIRST = "bucket long, blob binary, a long, b long, na long, nb long, c long, whole boolean"
TOTAL = np.dtype([("s", "<i8"), ("t", "<u4")])


def _rows(cols: tuple[np.ndarray, ...], whole: bool) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(cols[0]), 100_000):
        part = [pa.array(c[at : at + 100_000]) for c in cols]
        n = len(part[0])
        yield pa.record_batch([pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), *part, pa.array([whole] * n)], names=["bucket", "blob", "a", "b", "na", "nb", "c", "whole"])


def _blobs_of(rows: list[tuple[int | None, bytes]]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), 64):
        part = rows[k : k + 64]
        none = pa.nulls(len(part), pa.int64())
        yield pa.record_batch([pa.array([b for b, _ in part], pa.int64()), pa.array([x for _, x in part], pa.binary()), none, none, none, none, none, pa.nulls(len(part), pa.bool_())], names=["bucket", "blob", "a", "b", "na", "nb", "c", "whole"])


def _some(e: np.ndarray, first: np.ndarray, own: np.ndarray, number: int, shared: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each entry with the pivots of its block and of those next to it, and with
    the entry before it, if they are not connected. A pivot is the set most of
    whose prefix others have, as far as that is known: what the others of its
    block are copies of has all of it; of several, and at first, that of the
    smallest hash, another one each round. So a set meets the same few in all its
    lists."""
    size = np.diff(first)
    list_of = np.repeat(np.arange(len(size)), size)
    j, begin, end = np.arange(len(e)), first[list_of], first[list_of + 1] if len(e) else first[:0]
    starts = _firsts(list_of, _band(e["n"]))
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    h = tokens.mix64(e["s"].astype(np.uint64) + np.uint64(number * 0x9E3779B97F4A7C15 % (1 << 64))) if len(e) else np.zeros(0, np.uint64)
    known = np.zeros(len(e)) if shared is None else -shared / _prefix(e["n"].astype(np.int64))
    pivot = np.lexsort((h, known, group))[starts[:-1]]
    last = len(pivot) - 1
    i, k = np.concatenate([pivot[group], pivot[np.maximum(group - 1, 0)], pivot[np.minimum(group + 1, last)], j - 1]), np.tile(j, 4)
    ok = (i >= begin[k]) & (i < end[k]) & (i != k)
    i, k = i[ok], k[ok]
    ok = own[i] != own[k]
    return i[ok], k[ok]


def _first_pairs(buckets: int):
    """All pairs of short lists (``whole``), some of long ones, which go on as
    they are, and by bucket how many entries of a set are in lists at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, first = _lists(x for batch in batches for x in batch.column("blob").to_pylist())
        if not len(e):
            return
        size = np.diff(first)
        list_of = np.repeat(np.arange(len(size)), size)
        few = e[(size <= SHORT)[list_of]]
        for i, k in _block_pairs(few, _firsts(few["v"])):
            ok = _may(few[i], few[k])
            yield from _rows(_counted(few[i[ok]], few[k[ok]]), True)
        long = np.flatnonzero(size > SHORT)
        if len(long):
            held = e[(size > SHORT)[list_of]]
            i, k = _some(held, np.append(0, np.cumsum(size[long])), held["s"], 0)
            ok = _may(held[i], held[k])
            yield from _rows(_counted(held[i[ok]], held[k[ok]]), False)
            # Whole lists, about BUCKET entries at a time.
            cut = np.append(0, np.cumsum(size[long]))
            at = 0
            while at < len(long):
                to = max(at + 1, int(np.searchsorted(cut, cut[at] + BUCKET, "right")) - 1)
                yield from _blobs_of([(None, held[cut[at] : cut[to]].tobytes())])
                at = to
        s, t = np.unique(e["s"], return_counts=True)
        total = np.empty(len(s), TOTAL)
        total["s"], total["t"] = s, t
        b = (tokens.mix64(s.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        yield from _blobs_of([(int(x), total[b == x].tobytes()) for x in np.unique(b)])

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many prefix entries of each set another set has."""
    parts = [np.frombuffer(x, TOTAL) for batch in batches for x in batch.column("blob").to_pylist()]
    if parts:
        e = np.concatenate(parts)
        s, back = np.unique(e["s"], return_inverse=True)
        yield _batch(["s", "t"], s, np.bincount(back, e["t"]).astype(np.int64))


def _least(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Prefix entries that linked sets of these sizes share at least: what they
    have in common beyond them fits into the larger rest."""
    n, m = n.astype(np.int64), m.astype(np.int64)
    return _need(n, m) - (-(-NUM * np.maximum(n, m) // DEN) - 1)


PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("na", "<u4"), ("nb", "<u4"), ("c", "<u4"), ("whole", "<u4")])
PACKED = "bucket long, blob binary"


def _pack(cols: tuple[np.ndarray, ...], whole: bool, buckets: int) -> list[tuple[int, bytes]]:
    """Pairs by the bucket that sums them up."""
    e = np.empty(len(cols[0]), PAIR)
    for name, c in zip(("a", "b", "na", "nb", "c"), cols, strict=True):
        e[name] = c
    e["whole"] = whole
    a, b = e["a"].copy(), e["b"].copy()
    m = tokens.multipliers(2)
    h = (tokens.mix64(a.view(np.uint64) * m[0] + b.view(np.uint64) * m[1]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(h, kind="stable")
    cut = np.searchsorted(h[order], np.arange(buckets + 1)).tolist()
    return [(i, e[order[x:y]].tobytes()) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]


def _packed(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("whole").to_numpy(zero_copy_only=False)
            for w in (True, False):
                rows = _pack(tuple(batch.column(c).to_numpy()[whole == w] for c in ("a", "b", "na", "nb", "c")), w, buckets)
                yield _batch(["bucket", "blob"], pa.array([x for x, _ in rows], pa.int64()), pa.array([y for _, y in rows], pa.binary()))

    return run


def _summed(last: bool):
    """Pairs with how many prefix entries they share: enough of them, or, before
    the last round, a quarter of that in long lists, which count a pair only where
    it stands so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(x, PAIR) for batch in batches for x in batch.column("blob").to_pylist()]
        if not parts:
            return
        e = np.concatenate(parts)
        m = tokens.multipliers(2)
        key = tokens.mix64(e["a"].copy().view(np.uint64) * m[0] + e["b"].copy().view(np.uint64) * m[1])
        _, at, back = np.unique(key, return_index=True, return_inverse=True)
        c = np.bincount(back, e["c"]).astype(np.int64)
        whole = np.ones(len(at), bool)
        whole[back[e["whole"] == 0]] = False
        e = e[at]
        good = c >= _least(e["na"], e["nb"])
        if not last:
            good |= ~whole & (4 * c >= _least(e["na"], e["nb"])) & (c > 1)
        for k in range(0, int(good.sum()), 100_000):
            p = np.flatnonzero(good)[k : k + 100_000]
            yield _batch(["a", "b", "c"], e["a"][p], e["b"][p], c[p])

    return run


SUMMED = "a long, b long, c long"


def _owned(lists: pa.Table, sets: pa.Table) -> tuple[np.ndarray, ...]:
    """A part's entries, where its lists begin, and each entry's component and
    how many prefix entries of its set another has."""
    e, first = _lists(lists.column("blob").to_pylist())
    s, root, t = (sets.column(c).to_numpy() for c in ("s", "root", "t"))
    order = np.argsort(s)
    at = order[np.searchsorted(s[order], e["s"])] if len(e) else np.zeros(0, np.int64)
    return e, first, root[at], t[at]


class Tally:
    """Pairs with their counts. Lists give the same pairs again, so rows are summed
    whenever they have doubled, and ``settled`` drops those that are known to be no
    links: memory follows the pairs that differ and are open."""

    def __init__(self, settled: Callable[..., tuple[np.ndarray, ...]] | None = None) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 5]
        self.rows, self.most, self.settled = 0, 2 * PAIRS, settled

    def add(self, cols: tuple[np.ndarray, ...]) -> None:
        self.parts.append(cols)
        self.rows += len(cols[0])
        if self.rows > self.most:
            self.parts = [self.sums()]
            self.rows = len(self.parts[0][0])
            self.most = max(2 * PAIRS, 2 * self.rows)

    def sums(self) -> tuple[np.ndarray, ...]:
        a, b, na, nb, c = (np.concatenate([x[k] for x in self.parts]) for k in range(5))
        self.parts = []
        order = np.lexsort((b, a))
        a, b, na, nb, c = a[order], b[order], na[order], nb[order], c[order]
        first = _firsts(a, b)[:-1]
        out = a[first], b[first], na[first], nb[first], np.minimum(np.add.reduceat(c, first) if len(first) else c, CERTAIN)
        return self.settled(*out) if self.settled else out


def _packed_pairs(cols: tuple[np.ndarray, ...], buckets: int) -> pa.Table:
    rows = _pack(cols, False, buckets)
    return pa.table([pa.array([x for x, _ in rows], pa.int64()), pa.array([y for _, y in rows], pa.binary())], names=["bucket", "blob"])


def _round_pairs(number: int, buckets: int):
    """Some pairs of a part's lists whose sets are not connected yet."""

    def run(lists: pa.Table, sets: pa.Table) -> pa.Table:
        e, first, own, shared = _owned(lists, sets)
        out = Tally()
        if len(e):
            i, k = _some(e, first, own, number, shared)
            ok = _may(e[i], e[k]) & (np.minimum(shared[i], shared[k]) >= _least(e["n"][i], e["n"][k]))
            out.add(_counted(e[i[ok]], e[k[ok]]))
        return _packed_pairs(out.sums(), buckets)

    return run


# Answers of a component's first set, and what follows from them.


@dataclass
class Mixed:
    """Entries of lists that hold several components, by list and component;
    ``heavy`` are the runs [start, end) of those with ``HEAVY`` entries or more."""

    e: np.ndarray
    own: np.ndarray
    shared: np.ndarray
    first: np.ndarray  # of lists
    start: np.ndarray
    end: np.ndarray
    light: np.ndarray  # entries of no heavy run

    @staticmethod
    def of(e: np.ndarray, first: np.ndarray, own: np.ndarray, shared: np.ndarray) -> Mixed:
        size = np.diff(first)
        mixed = np.repeat(np.minimum.reduceat(own, first[:-1]) != np.maximum.reduceat(own, first[:-1]), size) if len(e) else np.zeros(0, bool)
        list_of = np.repeat(np.arange(len(size)), size)[mixed]
        e, own, shared = e[mixed], own[mixed], shared[mixed]
        order = np.lexsort((own, list_of))  # stable: by band and position within
        e, own, shared, list_of = e[order], own[order], shared[order], list_of[order]
        runs = _firsts(list_of, own)
        many = np.diff(runs) >= HEAVY
        return Mixed(e, own, shared, _firsts(list_of), runs[:-1][many], runs[1:][many], ~np.repeat(many, np.diff(runs)))

    def without(self, large: np.ndarray) -> tuple[Mixed, np.ndarray]:
        """Without the runs whose pairs are settled in blocks, and which light entries
        have others than those. The smallest ``large`` first set of a list answers for
        all that is light there and for larger names; smaller ones probe them still."""
        at = np.searchsorted(self.first, self.start, "right") - 1
        own = self.own[self.start]
        least = np.full(len(self.first) - 1, np.iinfo(np.int64).max)
        blocks = np.isin(own, large)
        np.minimum.at(least, at[blocks], own[blocks])
        left = own < least[at]
        light = self.light & np.repeat(least == np.iinfo(np.int64).max, np.diff(self.first))
        return replace(self, start=self.start[left], end=self.end[left]), light

    def probes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(entry, heavy run) of one list and of other components; of two heavy
        ones the entry is of the larger name."""
        at = np.searchsorted(self.first, self.start, "right") - 1
        for i, g in _ranges(self.first[at], self.first[at + 1], np.arange(len(at))):
            other = self.own[self.start[g]]
            ok = (self.own[i] != other) & (self.light[i] | (self.own[i] > other))
            yield i[ok], g[ok]


ASKED = "part long, a long, b long"


def _asked(lists: pa.Table, sets: pa.Table) -> pa.Table:
    """(a, b): the first sets of heavy components, and the sets that each is to be
    compared with, members and others."""
    m = Mixed.of(*_owned(lists, sets))
    found = [np.zeros((0, 2), np.int64)]
    member = np.concatenate([np.arange(a, b) for a, b in zip(m.start.tolist(), m.end.tolist(), strict=True)]) if len(m.start) else np.zeros(0, np.int64)
    found.append(np.unique(np.column_stack([m.own[member], m.e["s"][member]]), axis=0))
    for i, g in m.probes():
        found.append(np.unique(np.column_stack([m.own[m.start[g]], m.e["s"][i]]), axis=0))
    a, b = np.unique(np.concatenate(found), axis=0).T
    return pa.table([pa.array(np.full(len(a), lists.column("part")[0].as_py() if len(lists) else 0)), pa.array(a), pa.array(b)], names=["part", "a", "b"])


#: A count that no pair comes to: of links that follow without a comparison.
CERTAIN = 1 << 30


def _last_pairs(buckets: int):
    """All pairs of a part's lists that are not connected: those of light
    components by blocks, and of heavy ones what the first set's answers leave
    open; one pair where these make a link certain. Of answers without hashes the
    pairs are settled in blocks (``_near``)."""

    def run(lists: pa.Table, sets: pa.Table) -> pa.Table:
        answers = sets.filter(sets.column("o").is_valid())
        m = Mixed.of(*_owned(lists, sets.filter(sets.column("o").is_null())))
        m, light = m.without(np.unique(answers.filter(answers.column("lost").is_null()).column("root").to_numpy()))
        out = Tally(Answers(answers).settled)

        def add(x: np.ndarray, y: np.ndarray, at: np.ndarray, to: np.ndarray) -> None:
            ok = _may(x, y) & (np.minimum(at, to) >= _least(x["n"], y["n"]))
            out.add(_counted(x[ok], y[ok]))

        e, own, shared = m.e[light], m.own[light], m.shared[light]
        order = np.lexsort((e["p"], _band(e["n"]), e["v"]))
        e, own, shared = e[order], own[order], shared[order]
        for i, k in _block_pairs(e, _firsts(e["v"])):
            ok = own[i] != own[k]
            i, k = i[ok], k[ok]
            add(e[i], e[k], shared[i], shared[k])
        if len(m.start):
            _derived(m, answers, add, out.add)
        return _packed_pairs(out.sums(), buckets)

    return run


class Marks:
    """Sets of hashes by their places among all of them; ``twice`` leaves out what one
    set alone has. As rows of bits, 64 to a word, or as lists of places where bits would
    take over ``BITS`` bytes."""

    def __init__(self, parts: list[np.ndarray], twice: bool) -> None:
        size = np.array([len(x) for x in parts], np.int64)
        kinds, back, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        held = n[back] > 1 if twice else np.ones(len(back), bool)
        place = np.cumsum(n > 1) - 1 if twice else np.arange(len(kinds))
        row, self.place = np.repeat(np.arange(len(parts)), size)[held], place[back[held]]
        self.first = np.searchsorted(row, np.arange(len(parts) + 1))
        self.size = np.diff(self.first)
        self.words = int(self.place.max(initial=-1) // 64 + 1)
        self.bits = None
        if len(parts) * self.words * 8 <= BITS:
            self.bits = np.zeros((len(parts), self.words), np.uint64)
            np.bitwise_or.at(self.bits, (row, self.place // 64), np.uint64(1) << (self.place % 64).astype(np.uint64))

    def both(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many hashes each two sets share, with ``CHUNK`` bytes or so at a time."""
        out = np.zeros(len(p), np.int64)
        if not self.words:
            return out
        ends = np.cumsum(np.full(len(p), self.words) if self.bits is not None else self.size[p] + self.size[q])
        at = 0
        while at < len(p):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK // 8, "right")))
            x, y = p[at:to], q[at:to]
            if self.bits is not None:
                out[at:to] = np.bitwise_count(self.bits[x] & self.bits[y]).sum(axis=1, dtype=np.int64)
            else:
                rows = np.concatenate([x, y])
                n = self.size[rows]
                of = np.repeat(np.tile(np.arange(to - at), 2), n)
                key = np.sort(of << 32 | self.place[np.repeat(self.first[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
                out[at:to] = np.bincount(key[1:][key[1:] == key[:-1]] >> 32, minlength=to - at)
            at = to
        return out


def _among(names: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of ``x`` are among the sorted ``names``."""
    return names[np.minimum(np.searchsorted(names, x), len(names) - 1)] == x


class Answers:
    """What first sets of heavy components answer for pairs of sets: of two that one was
    compared with, what they share follows from how each differs from it. Pairs of answers
    without hashes are left to blocks."""

    def __init__(self, answers: pa.Table) -> None:
        apart = answers.filter(answers.column("lost").is_null())
        root, s = apart.column("root").to_numpy(), apart.column("s").to_numpy()
        self.apart = [np.unique(s[root == leader]) for leader in np.unique(root)]
        answers = answers.filter(answers.column("lost").is_valid())
        root, s, size = (answers.column(k).to_numpy() for k in ("root", "s", "t"))
        lost, more = ([v for c in answers.column(k).chunks for v in _views(c)] for k in ("lost", "more"))
        self.leaders = []
        for leader in np.unique(root):
            own = np.flatnonzero(root == leader)
            own = own[np.unique(s[own], return_index=True)[1]]
            gone, extra = ([x[j] for j in own] for x in (lost, more))
            self.leaders.append((s[own], int(size[own[0]]), np.array([len(x) for x in gone], np.int64), Marks(gone, False), Marks(extra, True)))

    def settled(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pairs without those that are no links; those that are are ``CERTAIN``."""
        open_, drop = c < CERTAIN, np.zeros(len(a), bool)
        c = c.copy()
        for names in self.apart:
            drop |= open_ & _among(names, a) & _among(names, b)
        open_ &= ~drop
        for names, n, fewer, gone, extra in self.leaders:
            left = np.flatnonzero(open_)
            i, k = (np.minimum(np.searchsorted(names, x[left]), len(names) - 1) for x in (a, b))
            met = (names[i] == a[left]) & (names[k] == b[left])
            left, i, k = left[met], i[met], k[met]
            lacks = _need(na[left], nb[left]) - (n - fewer[i] - fewer[k] + gone.both(i, k))
            may = np.flatnonzero(np.minimum(extra.size[i], extra.size[k]) >= lacks)
            link = may[extra.both(i[may], k[may]) >= lacks[may]]
            drop[left] = True
            drop[left[link]] = False
            c[left[link]] = CERTAIN
            open_[left] = False
        return tuple(x[~drop] for x in (a, b, na, nb, c))


def _derived(m: Mixed, answers: pa.Table, add, sure) -> None:
    """Pairs of heavy components' members with other sets: ``add`` gets those that
    the first set's answers leave open, and ``sure`` links that follow."""
    a, b, o, na = (answers.column(c).to_numpy().astype(np.int64) for c in ("root", "s", "o", "t"))
    mult = tokens.multipliers(2)
    name = lambda x, y: tokens.mix64(x.view(np.uint64) * mult[0] + y.view(np.uint64) * mult[1])
    key = name(a, b)
    order = np.argsort(key)
    key, o, na = key[order], o[order], na[order]

    def both(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(key, name(np.ascontiguousarray(x), np.ascontiguousarray(y)))
        return o[at], na[at]

    # A heavy run by band and then by how many n-grams the first set lacks, most first.
    run = np.repeat(np.arange(len(m.start)), m.end - m.start)
    member = np.concatenate([np.arange(x, y) for x, y in zip(m.start.tolist(), m.end.tolist(), strict=True)])
    e = m.e[member]
    shares, size = both(m.own[member], e["s"])
    more, less = e["n"] - shares, size - shares  # what the member has and what it lacks
    band = _band(e["n"])
    order = np.lexsort((-more, band, run))
    e, run, band, more, less, member = e[order], run[order], band[order], more[order], less[order], member[order]
    start = _firsts(run, band)
    begin = start[:-1]
    block = run[begin] * 1024 + band[begin]
    least = np.minimum.reduceat(e["n"].astype(np.int64), begin)
    place = np.repeat(np.arange(len(begin)), np.diff(start)) << 32 | (1 << 31) - more
    for i, g in m.probes():
        y = m.e[i]
        known, _ = both(m.own[m.start[g]], y["s"])
        for step in range(-BANDS, BANDS + 1):
            asked = g * 1024 + _band(y["n"]) + step
            at = np.minimum(np.searchsorted(block, asked), len(block) - 1)
            ok = np.flatnonzero(block[at] == asked)
            # The difference must make up for what the first set's answer lacks.
            lacks = np.maximum(_need(y["n"][ok], least[at[ok]]) - known[ok], 0)
            hi = np.searchsorted(place, at[ok] << 32 | (1 << 31) - np.minimum(lacks, (1 << 31) - 1), "right")
            for x, k in _ranges(begin[at[ok]], hi, ok):
                need = _need(e["n"][x], y["n"][k])
                open_ = known[k] + more[x] >= need
                x, k, need = x[open_], k[open_], need[open_]
                certain = known[k] - less[x] >= need
                done = np.unique(g[k[certain]] * len(m.e) + i[k[certain]], return_index=True)[1]
                c, d = e[x[certain][done]], y[k[certain][done]]
                turn = c["s"] > d["s"]
                c, d = np.where(turn, d, c), np.where(turn, c, d)
                sure((c["s"].copy(), d["s"].copy(), c["n"].astype(np.int64), d["n"].astype(np.int64), np.full(len(c), CERTAIN)))
                linked = np.isin(k, k[certain])
                x, k = x[~linked], k[~linked]
                add(e[x], y[k], m.shared[member[x]], m.shared[i[k]])


# Comparison.


def _views(column: pa.Array) -> list[np.ndarray]:
    """Each value's hashes, without a copy."""
    data, off = tokens.buffers(column)
    off = off.tolist()
    return [data[a:b].view(np.uint64) for a, b in zip(off[:-1], off[1:], strict=True)]


COMPARED = "a long, b long, o long, na long, nb long"


DIFFERENT = f"{COMPARED}, lost binary, more binary"


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same, with what of the first set the second lacks and what it has more."""
    for batch in batches:
        x, y = _views(batch.column("x")), _views(batch.column("y"))
        lost, more = ([np.setdiff1d(u, v, assume_unique=True) for u, v in zip(*z, strict=True)] for z in ((x, y), (y, x)))
        both = [len(u) - len(v) for u, v in zip(x, lost, strict=True)]
        numbers = [pa.array(c, pa.int64()) for c in (both, map(len, x), map(len, y))]
        yield pa.record_batch([batch.column("a"), batch.column("b"), *numbers, *[pa.array([v.tobytes() for v in c], pa.binary()) for c in (lost, more)]], names=["a", "b", "o", "na", "nb", "lost", "more"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many n-grams two sets share, and how many each has."""
    for batch in batches:
        x, y = _views(batch.column("x")), _views(batch.column("y"))
        both = [len(np.intersect1d(u, v, assume_unique=True)) for u, v in zip(x, y, strict=True)]
        yield pa.record_batch([batch.column("a"), batch.column("b"), *[pa.array(c, pa.int64()) for c in (both, map(len, x), map(len, y))]], names=["a", "b", "o", "na", "nb"])


def _near(answers: DataFrame, large: DataFrame, roots: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) between sets that one ``large`` first set was compared with,
    enough to connect what links connect. The sets of each are dealt to blocks by size and
    hash, and those of two blocks of which sizes allow links are one task's."""
    spread = answers.join(hinted(large), "a").join(roots.withColumnRenamed("node", "b"), "b", "left")
    held = spread.select("a", "b", F.coalesce("root", "b").alias("root"), "na", "nb", "lost", "more", F.floor(F.log2("nb") * 8).cast("int").alias("band"))
    held = keep(held, "near")
    bytes_ = F.sum(F.octet_length("lost") + F.octet_length("more"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / SIDE), F.ceil(bytes_ / SIDE_BYTES)).cast("int").alias("blocks")
    sizes = keep(held.groupBy("a", "band").agg(blocks), "near-sizes")
    here = F.struct("band", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"))
    mine = held.join(hinted(sizes), ["a", "band"]).withColumn("here", here).drop("blocks")
    others = mine.withColumn("to", F.explode(F.sequence(F.col("band") - BANDS, F.col("band") + BANDS))).join(hinted(sizes.withColumnRenamed("band", "to")), ["a", "to"])
    there = F.struct(F.col("to").alias("band"), F.col("block"))
    met = others.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("there", there)
    met = met.select("a", F.least("here", "there").alias("x"), F.greatest("here", "there").alias("y"), (F.col("here") <= F.col("there")).alias("before"), (F.col("here") >= F.col("there")).alias("after"), "b", "root", "na", "nb", "lost", "more")
    return keep(met.groupBy("a", "x", "y").applyInArrow(_near_links, "a long, b long"), "near-links")


def _near_links(rows: pa.Table) -> pa.Table:
    """Links between sets of two blocks, or of one, by how they differ from the first set
    of all; one between two components."""
    s, root, n, size = (rows.column(c).to_numpy() for c in ("b", "root", "nb", "na"))
    lost, more = ([v for c in rows.column(k).chunks for v in _views(c)] for k in ("lost", "more"))
    before, after = (np.flatnonzero(rows.column(c).to_numpy()) for c in ("before", "after"))
    found = [np.zeros((0, 4), np.int64)]
    if len(before) and len(after):
        gone, extra = Marks(lost, False), Marks(more, True)
        fewer, new = (np.array([len(x) for x in z], np.int64) for z in (lost, more))
        step = max(1, SETTLED // len(after))
        for at in range(0, len(before), step):
            i, k = (x.ravel() for x in np.meshgrid(before[at : at + step], after, indexing="ij"))
            # Of one block each pair comes twice.
            may = (root[i] < root[k]) if len(before) == len(after) == len(s) else (root[i] != root[k])
            i, k = i[may], k[may]
            need = _need(n[i], n[k])
            may = (np.minimum(n[i], n[k]) >= need) & (size[i] - np.maximum(fewer[i], fewer[k]) + np.minimum(new[i], new[k]) >= need)
            i, k, need = i[may], k[may], need[may]
            lacks = need - (size[i] - fewer[i] - fewer[k] + gone.both(i, k))
            may = np.flatnonzero(np.minimum(extra.size[i], extra.size[k]) >= lacks)
            link = may[extra.both(i[may], k[may]) >= lacks[may]]
            i, k = i[link], k[link]
            some = np.unique(np.column_stack([np.minimum(root[i], root[k]), np.maximum(root[i], root[k])]), axis=0, return_index=True)[1]
            i, k = i[some], k[some]
            found.append(np.column_stack([np.minimum(root[i], root[k]), np.maximum(root[i], root[k]), s[i], s[k]]))
    all_ = np.concatenate(found)
    a, b = all_[np.unique(all_[:, :2], axis=0, return_index=True)[1], 2:].T
    return pa.table([pa.array(a), pa.array(b)], names=["a", "b"])


def _blobs(words: int, every: bool = False):
    """Names and sets of the texts that are those asked for, or of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.pieces(batches, "text"):
            asked = [None] * batch.num_rows if every else batch.column("s").to_pylist()
            named = ((s, _name(x), x) for s, x in zip(asked, _sets(batch.column("text"), words), strict=True) if len(x))
            rows = [(own, x.tobytes()) for s, own, x in named if every or own == s]
            if rows:
                yield pa.record_batch([pa.array([s for s, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["s", "x"])

    return run


def _texts(asked: DataFrame, docs: DataFrame, classes: DataFrame, words: int, name: str, rows: int | None = None) -> DataFrame:
    """The sets of the classes asked for (``s``): their texts are read again. A
    set whose first document's row is repeated comes as often, which is harmless.
    Where no document of a class has an id, its name is looked for among those.
    If ``rows`` are known to be asked for, so many tasks name them, and once."""
    asked = asked.distinct() if rows is None else keep(asked.distinct().coalesce(tasks(rows, 20_000)), f"{name}-asked")
    ids = hinted(asked, BROADCAST).join(classes, "s").select("s", F.col("first").alias("id"))
    sets = docs.join(hinted(ids, BROADCAST), "id").mapInArrow(tokens.tidy(_blobs(words)), "s long, x binary")
    if not classes.where("first is null").isEmpty():
        every = docs.where("id is null").select("text").mapInArrow(tokens.tidy(_blobs(words, True)), "s long, x binary")
        sets = sets.unionByName(every.join(hinted(ids.where("id is null").select("s"), BROADCAST), "s", "left_semi").dropDuplicates(["s"]))
    return keep(sets, f"{name}-sets")


def _compared(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, name: str, differ: bool = False, rows: int | None = None) -> DataFrame:
    """The pairs (``a``, ``b``) with what they share, and how they ``differ``. Where very many sets are
    held against one, Spark splits the join; if there are known to be few ``rows``, few tasks take them."""
    sets = _texts(pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))), docs, classes, words, name, rows and 2 * rows)
    held = pairs.select("a", "b").join(sets.withColumnRenamed("s", "a"), "a")
    both = held.join(sets.withColumnsRenamed({"s": "b", "x": "y"}), "b")
    both = both if rows is None else both.coalesce(tasks(rows, 500, 24))
    compare, schema = (_differ, DIFFERENT) if differ else (_compare, COMPARED)
    out = keep(both.mapInArrow(tokens.tidy(compare), schema), f"{name}-compared")
    discard(sets)
    return out


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, name: str) -> DataFrame:
    """The pairs (``a``, ``b``) that are links."""
    return _compared(pairs, docs, classes, words, name).where(F.col("o") * (NUM + DEN) >= (F.col("na") + F.col("nb")) * NUM).select("a", "b")


def _between(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """Links among ``pairs`` (``a``, ``b``, ``c``, and their components ``root_a``
    and ``root_b``), enough to connect what links connect.

    Sets that pairs connect are a family. A large one is cut into blocks by hash,
    and the pairs of two blocks are one task's, which gets each set once; pairs of
    small families are dealt together.
    """
    family = components(pairs.select("a", "b")).withColumnsRenamed({"node": "a", "root": "family"})
    size = family.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    size = keep(size.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "family-sizes")
    placed = salted_join(family, size, ["family"], ["a"], how="inner")
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
    large = F.xxhash64("family", F.least(block("a"), block("b")), F.greatest(block("a"), block("b")))
    task = F.when(F.col("blocks") > 1, large).otherwise(F.pmod(F.xxhash64("family"), F.lit(tasks(pairs.count(), 500))))
    held = keep(pairs.join(placed, "a").select(task.alias("task"), "a", "b", "c", "root_a", "root_b"), "tasks")
    asked = keep(held.select("task", F.explode(F.array("a", "b")).alias("s")).distinct(), "task-sets")
    sets = _texts(asked.select("s"), docs, classes, words, "between")
    links = keep(held.groupBy("task").cogroup(asked.join(sets, "s").groupBy("task")).applyInArrow(_links, "a long, b long"), "between-links")
    discard(sets)
    return links


def _links(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """Links of a task's pairs, the likeliest first; none between what is connected by then."""
    x = dict(zip(sets.column("s").to_pylist(), (v for c in sets.column("x").chunks for v in _views(c)), strict=True))
    top: dict[int, int] = {}

    def up(r: int) -> int:
        while r in top:
            r = top[r]
        return r

    out: list[tuple[int, int]] = []
    a, b, c, u, w = (pairs.column(k).to_numpy() for k in ("a", "b", "c", "root_a", "root_b"))
    order = np.lexsort((b, a, -c))
    for i, j, p, q in zip(a[order].tolist(), b[order].tolist(), u[order].tolist(), w[order].tolist(), strict=True):
        p, q = up(p), up(q)
        if p != q:
            both = len(np.intersect1d(x[i], x[j], assume_unique=True))
            if (NUM + DEN) * both >= NUM * (len(x[i]) + len(x[j])):
                top[max(p, q)] = min(p, q)
                out.append((i, j))
    return pa.table([pa.array([i for i, _ in out], pa.int64()), pa.array([j for _, j in out], pa.int64())], names=["a", "b"])


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row for each of ``docs``: ``id``, ``n_shingles``, ``class_id`` (the
    smallest id with the same set) and ``component_id`` (the smallest id that
    links reach, 75 % of Jaccard similarity or more).

    A-Z are lower-cased; a text with fewer than ``words`` words is one shingle,
    one without words or a null is empty, is a class of its own and linked with
    nothing. Rows that repeat an id are taken one by one. A null id belongs to
    its class, but names it only if it has no other. n-grams and sets are
    compared by 64-bit hashes. Other columns are ignored; an empty table gives
    an empty result.
    """
    return _classed(docs, id_col, text_col, words).select("id", "n_shingles", "class_id", "component_id")


def _classed(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """What ``similar`` gives, with the set's name ``s`` and that of its component, ``root``."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = parts_of(rows, PARTS)
    scan = keep(rows.mapInArrow(tokens.tidy(_names(words, parts)), NAMES), "names")
    members = keep(scan.where("blob is null").select("id", "s", "n"), "members")
    total = members.agg(F.sum("n")).first()[0] or 0
    counted = scan.where("blob is not null").select("bucket", "blob").repartition(parts, "bucket").select("blob").coalesce(tasks(total, 3_000_000))
    top = counted.mapInArrow(tokens.tidy(_frequent(FREQUENT)), "h long, n long").orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    discard(scan)
    common = top["h"].to_numpy(np.int64).astype(np.uint32)
    order = np.argsort(common)
    frequent = spark.sparkContext.broadcast((common[order], (len(common) - order).astype(np.uint64)))
    classes = keep(members.where("s is not null").groupBy("s").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "classes")

    buckets = max(parts, total // DEN // BUCKET)
    index = rows.mapInArrow(tokens.tidy(_prefixes(words, buckets, frequent)), "bucket long, blob binary").repartition(buckets, "bucket").select("blob").coalesce(tasks(total // DEN, BUCKET))
    found = keep(index.mapInArrow(tokens.tidy(_first_pairs(parts)), FIRST), "lists")
    pairs = found.where("a is not null").drop("bucket", "blob")
    shared = keep(found.where("bucket is not null").select("bucket", "blob").repartition(parts, "bucket").select("blob").coalesce(tasks(total, 50_000_000)).mapInArrow(tokens.tidy(_totals), "s long, t long"), "shared")
    lists = keep(found.where("a is null and bucket is null").withColumn("part", F.monotonically_increasing_id()).select("part", "blob"), "parts")
    named = keep(lists.mapInArrow(tokens.tidy(_set_names), "part long, s long").join(shared, "s"), "named")

    best = Window.partitionBy("x").orderBy(F.desc("c"), "a", "b")

    def joined(more: DataFrame, roots: DataFrame | None) -> DataFrame:
        """What is connected needs one link a node; those of a round join these."""
        return keep(components(more if roots is None else more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "roots")

    made = found.count()

    def owned(roots: DataFrame) -> DataFrame:
        return named.join(roots.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))

    def summed(packed: DataFrame, last: bool) -> DataFrame:
        return packed.repartition(parts, "bucket").select("blob").coalesce(tasks(made, 500_000)).mapInArrow(tokens.tidy(_summed(last)), SUMMED)

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs of different roots."""
        for c in ("a", "b"):
            pairs = pairs.join(roots.withColumnsRenamed({"node": c, "root": f"root_{c}"}), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
        return pairs.where("root_a <> root_b")

    def counted(cross: DataFrame | None, roots: DataFrame, last: bool) -> DataFrame:
        """Pairs that are not tested yet, with how many prefix entries they share;
        before the last round, long lists count only some of these."""
        packed = pairs.where("whole").mapInArrow(tokens.tidy(_packed(parts)), PACKED)
        packed = packed if cross is None else packed.unionByName(cross)
        return apart(summed(packed, last).join(tested, ["a", "b"], "left_anti"), roots)

    # Pairs of long lists come as rows of their own; both sorts are summed alike.
    first = summed(pairs.mapInArrow(tokens.tidy(_packed(parts)), PACKED), False)
    roots = tested = cross = None
    short = lists.isEmpty()
    for number in range(1 if short else ROUNDS):
        if number:
            some = lists.groupBy("part").cogroup(owned(roots).groupBy("part")).applyInArrow(_round_pairs(number, parts), PACKED)
        met = keep(counted(some, roots, False) if number else first, "met")
        # Each set chooses one partner, that of most shared entries.
        sides = met.select("a", "b", "c", F.explode(F.array("a", "b")).alias("x"))
        asked = keep(sides.withColumn("r", F.row_number().over(best)).where("r = 1").groupBy("a", "b").agg(F.min("x").alias("x")), "asked")
        discard(met)
        more = _verified(asked.select(F.col("x").alias("a"), F.when(F.col("x") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("b")), rows, classes, words, "checked")
        asked = asked.select("a", "b")
        tested = asked if tested is None else tested.unionByName(asked)
        if number and more.isEmpty():
            break
        roots = joined(more, roots)

    # Of components with many entries in a list of others too, the first set answers.
    if not short:
        sets = keep(owned(roots), "owned")
        answered = keep(lists.groupBy("part").cogroup(sets.groupBy("part")).applyInArrow(_asked, ASKED), "to-answer")
        known = sets.withColumns({"o": F.lit(None).cast("long"), "lost": F.lit(None).cast("binary"), "more": F.lit(None).cast("binary")})
        if not answered.isEmpty():
            answers = _compared(answered.select("a", "b").distinct(), rows, classes, words, "answers", differ=True)
            large = keep(answers.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY).select("a"), "large")
            if not large.isEmpty():
                roots = joined(_near(answers, large, roots), roots)
                answers = answers.join(hinted(large.withColumn("apart", F.lit(True))), "a", "left").withColumns({c: F.when(F.col("apart").isNull(), F.col(c)) for c in ("lost", "more")})
            held = answered.join(answers, ["a", "b"]).select("part", F.col("b").alias("s"), F.col("na").alias("t"), F.col("a").alias("root"), "o", "lost", "more")
            known = known.unionByName(held)
        cross = lists.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_last_pairs(parts), PACKED)
    across = keep(counted(cross, roots, True), "across-pairs")
    if not across.isEmpty():
        roots = joined(_between(across, rows, classes, words), roots)

    # Only classes of several documents or with links need a join.
    named = classes.join(roots.withColumnRenamed("node", "s"), "s", "left").where("root is not null or n > 1").withColumn("root", F.coalesce("root", "s"))
    whole = named.groupBy("root").agg(F.min("first").alias("component_id"))
    per_class = salted_join(named, whole, ["root"], ["s"], how="inner", salts=4).select("s", "root", F.col("first").alias("class_id"), "component_id")
    out = salted_join(members.withColumn("_row", F.monotonically_increasing_id()), per_class, ["s"], ["_row"])
    return out.select("id", "s", F.coalesce("root", "s").alias("root"), F.col("n").alias("n_shingles"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id"))


def _set_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            s = np.unique(np.frombuffer(blob, ENTRY)["s"])
            yield _batch(["part", "s"], np.full(len(s), part), s)


def _with_names(text_col: str, words: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.pieces(batches, text_col):
            names = [_name(x) if len(x) else None for x in _sets(batch.column(text_col), words)]
            yield pa.record_batch([*batch.columns, pa.array(names, pa.int64())], names=[*batch.schema.names, name])

    return run


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id;
    of rows that repeat its id, all.

    A document without an id stays if its component has none and it is one of
    the set that is named first; of equal sets one. Without words, it stays.
    """
    classed = _classed(docs, id_col, text_col, words)
    own_id, own_s = unused(docs.columns, "own_id", "own_s")
    found = keep(classed.where("id = component_id").select(F.col("id").alias(own_id)).distinct(), "ones")
    out = docs.join(hinted(found), docs[id_col] == found[own_id], "left_semi")
    lost = docs.where(docs[id_col].isNull())
    if lost.isEmpty():
        return out
    first = keep(classed.where("id is null and component_id is null and s is not null").groupBy("root").agg(F.min("s").alias(own_s)).select(own_s), "unnamed-ones")
    named = lost.mapInArrow(tokens.tidy(_with_names(text_col, words, own_s)), StructType([*docs.schema.fields, StructField(own_s, LongType())]))
    ones = named.join(hinted(first), own_s, "left_semi").dropDuplicates([own_s])
    return out.unionByName(ones.drop(own_s)).unionByName(named.where(F.col(own_s).isNull()).drop(own_s))
