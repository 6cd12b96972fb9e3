"""Removal of repeated passages by FM-indexes.

A passage repeats if a window of ``WINDOW`` words also starts in a document with
a smaller id. Windows that are equal have the same minimiser, the smallest hash
of their ``GRAM``-word grams, so runs of windows with one minimiser are dealt to
shards by it, and only those whose minimiser occurs in another document. Each
shard builds a compressed FM-index of its distinct runs and streams the runs
through it backwards: the wavelet matrix gives each step's suffix interval, a
match is cut to the window's length, and the first suffix of the interval
belongs to the smallest document that has the window.

Suffixes are ordered by their first ``WINDOW`` words and then by document, which
is all that matches of up to that length need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .skew import parts_of, salted_join
from .store import keep, small_batches
from .text import unused

WINDOW, GRAM = 50, 20
#: Windows of a run, at most; words of an index and of a shard, about; runs of
#: one minimiser beyond which its windows are dealt one by one.
RUN, INDEX_WORDS, SHARD_WORDS, HOT = 64, 500_000, 1_500_000, 2_000
_BASE = int(tokens.multipliers(7)[-1])
_BACK = pow(_BASE, -1, 1 << 64)
KEYED = np.dtype([("key", "<u8"), ("c", "<u8"), ("doc", "<i8")])
PIECE = np.dtype([("key", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("n", "<u4"), ("words", "<u4")])


# Runs of windows.


class Runs:
    """The runs of a batch's texts: ``key``, ``c`` (the hash of its words),
    ``row``, ``at`` (first word, in the batch) and ``n`` windows."""

    def __init__(self, w: tokens.Words, window: int, gram: int) -> None:
        size = np.diff(w.first)
        none = np.zeros(0, np.int64)
        self.window, self.key, self.row, self.at, self.n, self.c = window, none.astype(np.uint64), none, none, none, none.astype(np.uint64)
        total = len(w.hash)
        if total < window:
            return
        v = np.zeros(total - gram + 1, np.uint64)
        for j, m in enumerate(tokens.multipliers(gram)):
            v += w.hash[j : j + len(v)] * m
        least, span, width = tokens.mix64(v), 1, window - gram + 1
        while 2 * span <= width:  # minima of twice as many grams
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        whole = np.repeat(np.maximum(size - window + 1, 0) > 0, size)[: len(least)]
        end = np.repeat(w.first[1:], size)[: len(least)]
        whole &= np.arange(len(least)) + window <= end
        at = np.flatnonzero(whole)
        if not len(at):
            return
        key = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1) | (end[at[1:]] != end[at[:-1]])
        begin = np.flatnonzero(new)
        inside = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        begin = np.flatnonzero(inside % RUN == 0)
        power = np.cumprod(np.full(total, _BASE, np.uint64))
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * power)])
        self.back = np.cumprod(np.full(total, _BACK, np.uint64))
        self.key, self.at, self.n = key[begin], at[begin], np.diff(np.append(begin, len(at)))
        self.row = np.searchsorted(w.first, self.at, "right") - 1
        self.c = self.hashes(self.at, self.n)

    def hashes(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of the words of n windows each."""
        words = n + self.window - 1
        return tokens.mix64((self.sum[at + words] - self.sum[at]) * self.back[at] + words.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def _by_bucket(key: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    b = (tokens.mix64(key ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cut = np.searchsorted(b[order], np.arange(buckets + 1)).tolist()
    return order, [(i, x, y) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]


def _blob_rows(got: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(got), 64):
        yield pa.record_batch([pa.array([b for b, _ in got[k : k + 64]], pa.int64()), pa.array([x for _, x in got[k : k + 64]], pa.binary())], names=["bucket", "blob"])


BLOBS = "bucket long, blob binary"


def _keys(window: int, gram: int, buckets: int):
    """First scan: each run's minimiser, words' hash and document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                all_ = np.concatenate(held)
                order, cuts = _by_bucket(all_["key"], buckets)
                all_ = all_[order]
                yield from _blob_rows([(b, all_[x:y].tobytes()) for b, x, y in cuts])
                held.clear()

        for batch in tokens.pieces(batches, "text"):
            runs = Runs(tokens.words(batch.column("text")), window, gram)
            e = np.empty(len(runs.key), KEYED)
            e["key"], e["c"], e["doc"] = runs.key, runs.c, batch.column("id").to_numpy()[runs.row]
            held.append(e)
            if sum(map(len, held)) > 400_000:
                yield from flush()
        yield from flush()

    return run


def _shared(hot: int):
    """Minimisers that two documents have, by document; ``hot`` are those of
    more distinct runs than that. ``runs`` says how many runs there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(x, KEYED) for batch in batches for x in batch.column("blob").to_pylist()]
        if not parts:
            return
        e = np.concatenate(parts)
        e = e[np.lexsort((e["c"], e["key"]))]
        new = np.ones(len(e), bool)
        new[1:] = e["key"][1:] != e["key"][:-1]
        other = np.ones(len(e), bool)
        other[1:] = new[1:] | (e["c"][1:] != e["c"][:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(e)))
        shared = np.minimum.reduceat(e["doc"], first) != np.maximum.reduceat(e["doc"], first)
        many = np.add.reduceat(other.astype(np.int64), first) > hot
        keep_ = np.repeat(shared, size)
        e, many = e[keep_], np.repeat(many, size)[keep_]
        order = np.argsort(e["doc"], kind="stable")
        e, many = e[order], many[order]
        cut = np.append(np.flatnonzero(np.append(True, e["doc"][1:] != e["doc"][:-1])) if len(e) else [], len(e)).astype(np.int64).tolist()
        for k in range(0, len(cut) - 1, 5000):
            spans = list(zip(cut[k : k + 5000], cut[k + 1 : k + 5001], strict=False))
            yield pa.record_batch(
                [pa.array([int(e["doc"][x]) for x, _ in spans], pa.int64()), pa.array([np.unique(e["key"][x:y]).tobytes() for x, y in spans]), pa.array([np.unique(e["key"][x:y][many[x:y]]).tobytes() for x, y in spans]), pa.array([y - x for x, y in spans], pa.int64())],
                names=["id", "keys", "hot", "runs"],
            )

    return run


def _pairs_of(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return tokens.mix64(keys + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys of a column of lists of blobs."""
    got = [np.frombuffer(b"".join(x), np.uint64) for x in column.to_pylist()]
    return np.repeat(np.arange(len(got)), [len(x) for x in got]), np.concatenate(got) if got else np.zeros(0, np.uint64)


CUT = "bucket long, blob binary, c long, id long, th long, at int, n int"


def _cut(window: int, gram: int, buckets: int):
    """Second scan: the shared runs. A distinct run of a task goes to its shard
    once, with its words; where each stands goes on beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        held: list[tuple[np.ndarray, list[bytes]]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                e, text = np.concatenate([x for x, _ in held]), [y for _, ys in held for y in ys]
                _, at, back = np.unique(e["c"], return_index=True, return_inverse=True)
                least = np.full(len(at), np.iinfo(np.int64).max)
                np.minimum.at(least, back, e["doc"])
                e, n = e[at], np.bincount(back)
                e["doc"], e["n"] = least, n
                order, cuts = _by_bucket(e["key"], buckets)
                rows = []
                for b, x, y in cuts:
                    own = order[x:y]
                    rows.append((b, squeeze.compress(np.int64(len(own)).tobytes() + e[own].tobytes() + b" ".join(text[at[i]] for i in own))))
                for r in _blob_rows(rows):
                    yield pa.record_batch([*r.columns, *[pa.nulls(r.num_rows, pa.int64())] * 3, *[pa.nulls(r.num_rows, pa.int32())] * 2], names=["bucket", "blob", "c", "id", "th", "at", "n"])
                held.clear()

        for batch in tokens.pieces(batches, "text"):
            w = tokens.words(batch.column("text"))
            runs = Runs(w, window, gram)
            ask = _pairs_of(runs.row, runs.key)
            chosen = np.isin(ask, _pairs_of(*_listed(batch.column("keys"))))
            split = np.isin(ask, _pairs_of(*_listed(batch.column("hot")))) & chosen
            chosen &= ~split
            one = np.repeat(np.flatnonzero(split), runs.n[split])
            step = np.arange(len(one)) - np.repeat(np.cumsum(runs.n[split]) - runs.n[split], runs.n[split])
            at, n, row = np.concatenate([runs.at[chosen], runs.at[one] + step]), np.concatenate([runs.n[chosen], np.ones(len(one), np.int64)]), np.concatenate([runs.row[chosen], runs.row[one]])
            if not len(at):
                continue
            c = np.concatenate([runs.c[chosen], runs.hashes(runs.at[one] + step, np.ones(len(one), np.int64))])
            key = np.concatenate([runs.key[chosen], c[len(runs.key[chosen]) :]])
            ids, th = batch.column("id").to_numpy(), batch.column("th").to_numpy()
            for k in range(0, len(at), 100_000):
                p = slice(k, k + 100_000)
                m = len(at[p])
                yield pa.record_batch([pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(c[p].view(np.int64)), pa.array(ids[row[p]]), pa.array(th[row[p]]), pa.array((at[p] - w.first[row[p]]).astype(np.int32)), pa.array(n[p].astype(np.int32))], names=["bucket", "blob", "c", "id", "th", "at", "n"])
            e = np.empty(len(at), PIECE)
            e["key"], e["c"], e["doc"], e["n"], e["words"] = key, c, ids[row], 1, n + window - 1
            raw = w.data.tobytes()
            held.append((e, [raw[a:b] for a, b in zip(w.start[at].tolist(), w.end[at + n + window - 2].tolist(), strict=True)]))
            size += int(e["words"].sum())
            if size > 2_000_000:
                yield from flush()
                size = 0
        yield from flush()

    return run


# The index.


class BitVector:
    """Bits with counts in two steps: of all before every eighth word, and of
    those from there on before each word. That is 1.3 bits a bit."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits) // 64 + 1
        words = np.zeros(n, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1]
        self.words, self.far = words, before[::8].astype(np.uint32)
        self.near = (before - self.far[np.arange(n) >> 3]).astype(np.uint16)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.far[word >> 3].astype(np.int64) + self.near[word] + np.bitwise_count(self.words[word] & low)


class Groups:
    """Runs of places, by a bit where each begins and one number a run."""

    def __init__(self, begins: np.ndarray) -> None:
        self.bits, self.start = BitVector(begins), np.append(np.flatnonzero(begins), len(begins)).astype(np.uint32)

    def of(self, i: np.ndarray) -> np.ndarray:
        return self.bits.rank(i + 1) - 1


class WaveletMatrix:
    """Counts of a symbol before a place, bit by bit from the highest."""

    def __init__(self, text: np.ndarray, kinds: int) -> None:
        self.levels: list[tuple[int, BitVector, int]] = []
        for bit in reversed(range(max(1, int(kinds - 1).bit_length()))):
            ones = (text >> bit & 1).astype(bool)
            zero = text[~ones]
            self.levels.append((bit, BitVector(ones), len(zero)))
            text = np.concatenate([zero, text[ones]])
        # Where each symbol's own block begins after the last level.
        self.first = np.zeros(kinds, np.int64)
        at = np.zeros(kinds, np.int64)
        every = np.arange(kinds)
        for bit, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(every >> bit & 1, zeros + ones, at - ones)
        self.first = at

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where(symbol >> bit & 1, zeros + ones, i - ones)
        return i - self.first[symbol]


class FMIndex:
    """Of texts that end with the symbol 0, for matches up to ``window`` words."""

    def __init__(self, text: np.ndarray, doc: np.ndarray, window: int) -> None:
        n = len(text)
        kinds = int(text.max()) + 1
        rank, span, half = text.astype(np.int64), 1, None

        def joined(rank: np.ndarray, step: int) -> np.ndarray:
            later = np.zeros(n, np.int64)
            later[: n - step] = rank[step:] + 1 if step < n else 0
            order = np.argsort(key := rank * (int(rank.max()) + 2) + later)
            new = np.zeros(n, np.int64)
            new[1:] = key[order[1:]] != key[order[:-1]]
            out = np.empty(n, np.int64)
            out[order] = np.cumsum(new)
            return out

        while 2 * span < window:
            rank = joined(rank, span)
            span *= 2
        half = rank
        rank = joined(rank, window - span) if span < window else rank
        order = np.argsort(rank * (int(doc.max()) + 1) + doc)
        new = np.ones(n, bool)  # suffixes whose first window words are the same are one group
        new[1:] = rank[order[1:]] != rank[order[:-1]]
        self.whole = Groups(new)
        # Documents are sampled: only that of a group's first suffix, the smallest, is kept.
        self.least = doc[order[new]].astype(np.uint32)
        # Suffixes whose first window - 1 words are the same.
        same = np.zeros(n, bool)
        same[1:] = half[order[1:]] == half[order[:-1]]
        if window - 1 > span:
            shift = window - 1 - span
            later = np.full(n, -1)
            later[: n - shift] = half[shift:]
            same[1:] &= later[order[1:]] == later[order[:-1]]
        self.cut = Groups(~same)
        self.bwt = WaveletMatrix(text[order - 1], kinds)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=kinds))])
        self.text, self.window, self.n = text.astype(np.uint32), window, n

    def windows(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each word at which a whole window of the runs [begin, end) starts,
        the smallest document that has it; -1 elsewhere."""
        out = np.full(self.n, -1, np.int64)
        order = np.argsort(begin - end, kind="stable")  # the longest first
        size = (end - begin)[order]
        at = end[order] - 1
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64)
        for step in range(1, int(size.max()) + 1 if len(size) else 1):
            k = int(np.searchsorted(-size, -step, "right"))
            a, b, here = lo[:k], hi[:k], at[:k] - (step - 1)
            if step > self.window:  # the match is cut by a word at its end
                group = self.cut.of(a)
                a, b = (self.cut.start[group + k].astype(np.int64) for k in (0, 1))
            symbol = self.text[here]
            both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([a, b])) + np.tile(self.before[symbol], 2)
            lo[:k], hi[:k] = both[:k], both[k:]
            if step >= self.window:
                out[here] = self.least[self.whole.of(lo[:k])]
        if not (lo < hi).all():
            raise AssertionError("an indexed run was not found")
        return out


FOUND = "c long, m long, spans array<struct<s:int,e:int>>"


def _index(window: int, alone: bool = False):
    """A shard: what each distinct run loses in its smallest document ``m``.
    Every other document loses all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = zstandard.ZstdDecompressor()
        heads, hashes = [], []
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                raw = loose.decompress(blob)
                k = int(np.frombuffer(raw, np.int64, 1)[0])
                heads.append(np.frombuffer(raw, PIECE, k, 8))
                hashes.append(tokens.words(pa.array([raw[8 + k * PIECE.itemsize :]], pa.large_binary())).hash)
        if not heads:
            return
        e, h = np.concatenate(heads), np.concatenate(hashes)
        begin = np.cumsum(e["words"], dtype=np.int64) - e["words"]
        order = np.lexsort((e["doc"], e["c"], e["key"]))
        e, begin = e[order], begin[order]
        new = np.ones(len(e), bool)  # the first of each run has its smallest document
        new[1:] = (e["c"][1:] != e["c"][:-1]) | (e["key"][1:] != e["key"][:-1])
        count = np.add.reduceat(e["n"].astype(np.int64), np.flatnonzero(new))
        e, begin = e[new], begin[new]
        fresh = np.ones(len(e), bool)
        fresh[1:] = e["key"][1:] != e["key"][:-1]
        starts = np.append(np.flatnonzero(fresh), len(e))
        ends = np.cumsum(e["words"] + 1, dtype=np.int64)
        at = 0
        while at < len(e):  # whole minimisers, about INDEX_WORDS words at a time
            base = int(ends[at - 1]) if at else 0
            to = int(starts[max(np.searchsorted(starts, at, "right"), np.searchsorted(starts, np.searchsorted(ends, base + INDEX_WORDS, "right"), "right") - 1)])
            yield from _searched(e[at:to], begin[at:to], count[at:to], h, window)
            at = to

    return run


def _searched(e: np.ndarray, begin: np.ndarray, count: np.ndarray, h: np.ndarray, window: int) -> Iterator[pa.RecordBatch]:
    n = e["words"].astype(np.int64)
    end = np.cumsum(n + 1) - 1  # where each run's closing 0 is
    place = np.arange(int(n.sum())) + np.repeat(np.arange(len(n)), n)
    text = np.zeros(int(end[-1]) + 1, np.int64)
    _, symbol = np.unique(h[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], return_inverse=True)
    text[place] = symbol + 1
    docs, doc = np.unique(e["doc"], return_inverse=True)
    found = FMIndex(text, np.repeat(doc, n + 1), window).windows(end - n, end)
    lost = (found >= 0) & (found < np.repeat(doc, n + 1))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], lost.astype(np.int8), [0]])))
    s, t = edge[::2], edge[1::2]
    owner = np.searchsorted(end, s)
    s, t = (s - (end - n)[owner]).astype(np.int32), (t - (end - n)[owner]).astype(np.int32)
    say = (count > 1) | np.isin(np.arange(len(e)), owner)
    cut = np.searchsorted(owner, np.arange(len(e)))
    size = np.diff(np.append(cut, len(owner)))[say]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(s), pa.array(t)], ["s", "e"]))
    yield pa.record_batch([pa.array(e["c"][say].view(np.int64)), pa.array(e["doc"][say]), spans], names=["c", "m", "spans"])


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``id``, ``th`` (the text's hash) and ``lost``: the word intervals [{s, e}]
    that repeat a smaller document, of every document that has any."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = parts_of(rows)
    keyed = rows.mapInArrow(tokens.tidy(_keys(window, gram, parts)), BLOBS).repartition(parts, "bucket").select("blob").mapInArrow(tokens.tidy(_shared(hot)), "id long, keys binary, hot binary, runs long")
    shared = keep(keyed, "minimisers")
    runs = shared.agg(F.sum("runs")).first()[0] or 0
    shards = max(parts, runs * (window + 15) // SHARD_WORDS)
    listed = shared.groupBy("id").agg(F.collect_list("keys").alias("keys"), F.collect_list("hot").alias("hot"))
    cut = keep(rows.withColumn("th", F.xxhash64("text")).join(listed.hint("merge"), "id").mapInArrow(tokens.tidy(_cut(window, gram, shards)), CUT), "runs")
    found = keep(cut.where("blob is not null").select("bucket", "blob").repartition(shards, "bucket").select("blob").mapInArrow(tokens.tidy(_index(window)), FOUND), "found")
    places = cut.where("c is not null").select("c", "id", "th", "at", "n")
    met = salted_join(places, found, ["c"], ["id", "at"], how="inner", follows=True).where("id > m or size(spans) > 0")
    word = lambda s, e: F.struct((F.col("at") + s).alias("s"), (F.col("at") + e + (window - 1)).alias("e"))
    spans = F.when(F.col("id") > F.col("m"), F.array(word(F.lit(0), F.col("n")))).otherwise(F.transform("spans", lambda x: word(x["s"], x["e"])))
    return met.select("id", "th", spans.alias("spans")).groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("lost"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``docs`` with ``kept_text`` (the words that stay, joined by a space),
    ``n_words`` and ``n_removed``.

    A word goes if a window over it also starts in a document with a smaller
    id; windows are those of the text as it came. Words are runs of anything
    but ASCII white space, as they are written. A null text has no words. A
    null id is no document: its row neither loses words nor takes any from
    others. Rows that repeat an id are one document, and each loses what it
    has in common with smaller ones. Columns named as those above are
    replaced; an empty table gives an empty result.
    """
    rest = [c for c in docs.columns if c not in ("kept_text", "n_words", "n_removed")]
    i, th, spans = unused(docs.columns, "id", "th", "lost")
    lost = repeated(docs, id_col, text_col, window, gram, hot).select(F.col("id").alias(i), F.col("th").alias(th), F.col("lost").alias(spans))
    rows = docs.select(*rest)
    joined = rows.join(lost.hint("merge"), (F.col(id_col).cast("long") == F.col(i)) & (F.xxhash64(text_col) == F.col(th)), "left").select(*rest, spans)
    schema = T.StructType([*rows.schema.fields, T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.pieces(batches, text_col):
            data, off = tokens.buffers(batch.column(text_col))
            raw, gone = data.tobytes(), batch.column(spans)
            kept, n, removed = [], [], []
            has = gone.is_valid().to_numpy(zero_copy_only=False)
            for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                words = raw[a:b].split()
                n.append(len(words))
                if has[i]:
                    level = np.zeros(len(words) + 1, np.int64)
                    for x in gone[i].as_py():
                        level[x["s"]] += 1
                        level[x["e"]] -= 1
                    stay = np.flatnonzero(np.cumsum(level)[:-1] == 0)
                    removed.append(len(words) - len(stay))
                    words = [words[j] for j in stay.tolist()]
                else:
                    removed.append(0)
                kept.append(b" ".join(words))
            cols = [batch.column(c) for c in rest]
            yield pa.record_batch([*cols, pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=schema.names)

    return joined.mapInArrow(tokens.tidy(run), schema)
