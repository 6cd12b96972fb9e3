"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated bigram models, of toxic and of ordinary labelled documents, give
a text its log-likelihoods. A bigram's count is discounted by what the counts of
counts say, and backs off to how many different words a word follows in its
class; that is discounted alike and backs off to counts of the whole corpus that
both classes share, so an expression that is rare in the labelled documents says
about the same under either.

What the difference of the two is worth is measured and not assumed: words of
other labelled documents are put in cells by how large it is and by how often the
sample has the expression, and a cell's evidence is how much more often toxic
documents come to it than ordinary ones. So a difference that rests on one
occurrence counts for what such differences have been worth. A text's evidence,
normalised by length, and that of its most toxic word make its score by a logistic
curve.

The counting, shared counts over every document included, is distributed, and so
is what follows from it. Only differences of bigrams, words and contexts of the
labelled sample, which ``per_class`` bounds, are broadcast; every other word has
one difference that stands for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .store import discard, keep, small_batches

#: Labelled documents of a class that are learnt from, at most (about: dealt by
#: hash). The broadcast tables follow this and not the corpus: 13 bytes for each
#: distinct bigram of the sample.
PER_CLASS = 4_000
CLASSES = ("ordinary", "toxic")
#: Cells are of differences a unit apart, from -UNITS to UNITS, and of expressions
#: seen 1, 2 to 3, 4 to 7 times and so on, in so many levels; 0 are those not seen.
UNITS, LEVELS = 6, 8
CELLS = 2 * UNITS * LEVELS
#: Distinct n-grams that a task gathers before it hands them on.
FLUSH = 400_000
FOLDS = 5
HELD_OUT, CALIBRATE = 0, 4
_PUNCT = np.zeros(256, bool)
_PUNCT[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo ``FOLDS``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


@dataclass
class Table:
    """Values by 64-bit hashes. Hashes are spread evenly, so their first bits say
    about where one stands."""

    key: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    columns: list[np.ndarray] = field(default_factory=list)
    start: np.ndarray = field(default_factory=lambda: np.zeros(3, np.uint32))

    @staticmethod
    def of(key: np.ndarray, *columns: np.ndarray) -> Table:
        key = key.view(np.uint64)
        order = np.argsort(key)
        key, bits = key[order], max(1, len(key).bit_length())
        first = np.searchsorted(key, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        return Table(key, [c[order] for c in columns], np.append(first, len(key)).astype(np.uint32))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``keys`` are there, by place, and where."""
        keys = keys.view(np.uint64)
        b = (keys >> np.uint64(64 - (len(self.start) - 1).bit_length() + 1)).astype(np.int64)
        at, end = self.start[b].astype(np.int64), self.start[b + 1]
        live, found = np.flatnonzero(at < end), [np.zeros(0, np.int64)]
        while len(live):
            same = self.key[at[live]] == keys[live]
            found.append(live[same])
            live = live[~same]
            at[live] += 1
            live = live[at[live] < end[live]]
        hit = np.sort(np.concatenate(found))
        return hit, at[hit]


@dataclass
class Model:
    """Differences of log-likelihoods, toxic less ordinary, and the levels that
    they rest on. ``words``: of a word by itself, its level, and what is added for
    a word after it if the two aren't in the sample together; ``bigrams``: of a
    word after another; ``other``: of a word that isn't in the sample."""

    words: Table = field(default_factory=lambda: Table(columns=[np.zeros(0, np.float32), np.zeros(0, np.uint8), np.zeros(0, np.float32)]))
    bigrams: Table = field(default_factory=lambda: Table(columns=[np.zeros(0, np.float32), np.zeros(0, np.uint8)]))
    other: float = 0.0
    evidence: np.ndarray = field(default_factory=lambda: np.zeros(CELLS))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(3))
    scale: np.ndarray = field(default_factory=lambda: np.ones(3))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))
    prior: float = 0.0

    def differences(self, w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word, given the one before it in its row, and the level."""
        x, level = np.full(len(w), self.other), np.zeros(len(w), np.int64)
        if not len(w):
            return x, level
        known, at = self.words.find(w)
        x[known], level[known] = self.words.columns[0][at], self.words.columns[1][at]
        context, inside = np.zeros(len(w)), np.zeros(len(w), bool)
        context[known], inside[known] = self.words.columns[2][at], True
        after = inside.copy()  # a bigram is of known words
        after[1:] &= inside[:-1]
        begins = first[:-1][np.diff(first) > 0]
        after[begins] = False
        context = np.roll(context, 1)
        context[begins] = 0.0
        x += context
        both = np.flatnonzero(after)
        pair, place = self.bigrams.find(_pair(w[both - 1], w[both]))
        x[both[pair]], level[both[pair]] = self.bigrams.columns[0][place], self.bigrams.columns[1][place]
        return x, level

    def features(self, cells: np.ndarray) -> np.ndarray:
        """Three numbers for each row of counts by cell: the mean evidence, the
        largest, and the logarithm of the length, which makes up for more words
        having a more toxic one."""
        n = cells.sum(axis=1)
        best = np.where(cells > 0, self.evidence, -np.inf).max(axis=1, initial=-np.inf)
        return np.column_stack([(cells * self.evidence).sum(axis=1) / np.maximum(n, 1), np.where(n > 0, best, 0.0), np.log1p(n)])


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words without ASCII punctuation at either end,
    and where each row's begin."""
    w = tokens.words(texts, lower=True)
    start, end = w.start.copy(), w.end.copy()
    for at, by in ((end, -1), (start, 1)):
        more = np.arange(len(start))
        while len(more):
            byte = w.data[end[more] - 1] if by < 0 else w.data[start[more]]
            more = more[(end[more] - start[more] > 1) & _PUNCT[byte]]
            at[more] += by
    return tokens.hash_spans(w.data, start, end).view(np.int64), w.first


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    m = tokens.multipliers(2)
    return tokens.mix64(v.view(np.uint64) * m[0] + w.view(np.uint64) * m[1])


def histogram(texts: pa.Array, model: Model) -> np.ndarray:
    """How many words of each text are in each cell."""
    w, first = _words(texts)
    x, level = model.differences(w, first)
    n = len(first) - 1
    cell = level * 2 * UNITS + np.clip(np.floor(x).astype(np.int64) + UNITS, 0, 2 * UNITS - 1)
    return np.bincount(np.repeat(np.arange(n), np.diff(first)) * CELLS + cell, minlength=n * CELLS).reshape(n, CELLS)


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    cells = histogram(texts, model)
    z = ((model.features(cells) - model.mean) / model.scale * model.weights[:-1]).sum(axis=1) + model.weights[-1]
    return np.where(cells.any(axis=1), 1 / (1 + np.exp(-np.clip(z, -30, 30))), model.prior)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, per_class: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, class and fold of the documents to learn from: no held-out ones, one
    of each text, about ``per_class`` of each class at most."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("toxic")).where(fold("_id") != HELD_OUT)
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.lower(text_col)).alias("h"))
    one = known.join(texts, "_id").groupBy("h").agg(F.min_by(F.struct("_id", "toxic"), "_id").alias("x")).select("x.*")
    one = keep(one.select(F.xxhash64("_id").alias("k"), (F.col("toxic") > 0).cast("int").alias("c"), fold("_id").alias("f")), "labelled")
    size = {r["c"]: r["n"] for r in one.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = 1 << 20
    share = [min(part, per_class * part // max(1, size.get(c, 0))) for c in (0, 1)]
    got = one.where(F.pmod(F.xxhash64("k"), F.lit(part)) < F.when(F.col("c") == 1, share[1]).otherwise(share[0])).toPandas().sort_values("k")
    return got["k"].to_numpy(np.int64), got["c"].to_numpy(np.int64), got["f"].to_numpy(np.int64)


COUNTS = "gram int, v long, w long, n long, ordinary long, toxic long"


def _counter(key: np.ndarray, label: np.ndarray):
    """Counts of words over all rows, and of bigrams over labelled ones."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held[0]:
                w, n = np.unique(np.concatenate(held[0]), return_counts=True)
                zero = np.zeros(len(w), np.int64)
                yield from _batches(1, zero, w, n, zero, zero)
            for c in (0, 1):
                if held[1 + c]:
                    pairs = np.concatenate(held[1 + c])
                    _, at, n = np.unique(_pair(pairs[:, 0].copy(), pairs[:, 1].copy()), return_index=True, return_counts=True)
                    zero = np.zeros(len(at), np.int64)
                    yield from _batches(2, pairs[at, 0], pairs[at, 1], zero, zero if c else n, n if c else zero)
            for x in held:
                x.clear()

        for batch in tokens.pieces(batches, "text"):
            w, first = _words(batch.column("text"))
            held[0].append(w)
            size += len(w)
            if len(key):
                k = np.asarray(batch.column("k"))
                at = np.minimum(np.searchsorted(key, k), len(key) - 1)
                for row in np.flatnonzero(key[at] == k):
                    own = w[first[row] : first[row + 1]]
                    held[1 + label[at[row]]].append(np.column_stack([own[:-1], own[1:]]))
            if size > FLUSH:
                yield from flush()
                size = 0
        yield from flush()

    return add


def _batches(gram: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), 100_000):
        part = [pa.array(c[i : i + 100_000].astype(np.int64)) for c in columns]
        yield pa.record_batch([pa.array(np.full(len(part[0]), gram, np.int32)), *part], names=["gram", "v", "w", "n", "ordinary", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    """Learn from ``labels`` (id, ``toxic``) and the texts of ``docs``.

    Ids of fold ``HELD_OUT`` are never learnt from; fold ``CALIBRATE`` fits the
    curve and the others the counts. Ids labelled twice are toxic if either
    label is; null labels and ids are passed over; of equal texts one counts.
    Without documents of both classes every score is the share of toxic ones. A class
    whose texts have one word each has the shared counts alone.
    Case and punctuation around a word don't count, words by 64-bit hashes.
    """
    spark = docs.sparkSession
    key, label, part = _sample(docs, labels, id_col, text_col, per_class)
    model = Model(prior=float(label[part == CALIBRATE].mean()) if (part == CALIBRATE).any() else float(label.mean()) if len(label) else 0.0)
    counted = part != CALIBRATE
    if len(set(label[counted])) < 2 or len(set(label[~counted])) < 2:
        p = min(max(model.prior, 1e-9), 1 - 1e-9)
        model.weights[-1] = np.log(p / (1 - p))
        return model
    rows = docs.select(F.xxhash64(id_col).alias("k"), F.col(text_col).alias("text"))
    small_batches(spark)
    partial = rows.mapInArrow(tokens.tidy(_counter(key[counted], label[counted])), COUNTS)
    counts = keep(partial.groupBy("gram", "v", "w").agg(*[F.sum(c).alias(c) for c in ("n", *CLASSES)]), "counts")
    _differences(counts, model)
    discard(counts)

    tables, own, classes = spark.sparkContext.broadcast(model), key[~counted], label[~counted]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.pieces(batches, "text"):
            k = np.asarray(batch.column("k"))
            at = np.minimum(np.searchsorted(own, k), len(own) - 1)
            mine = np.flatnonzero(own[at] == k)
            if len(mine):
                cells = histogram(batch.column("text").take(pa.array(mine)), tables.value)
                off = pa.array(np.arange(0, cells.size + 1, CELLS, dtype=np.int32))
                yield pa.record_batch([pa.array(k[mine]), pa.array(classes[at[mine]].astype(np.int32)), pa.ListArray.from_arrays(off, pa.array(cells.ravel()))], names=["k", "y", "cells"])

    got = rows.mapInArrow(tokens.tidy(measure), "k long, y int, cells array<long>").toPandas()
    tables.destroy()
    cells, y = np.array(got["cells"].tolist(), np.int64).reshape(-1, CELLS), got["y"].to_numpy()
    order = np.lexsort([*cells.T, got["k"].to_numpy()])
    _calibrate(model, cells[order], y[order])
    return model


def _discount(counts: DataFrame, columns: tuple[str, ...]) -> dict[str, float]:
    """What is taken from each count of a column: n1 / (n1 + 2 n2), where n1 and
    n2 say how many counts are 1 and 2; a half where no count is."""
    got = counts.agg(*[F.count(F.when(F.col(c) == k, 1)).alias(f"{c}_{k}") for c in columns for k in (1, 2)]).first()
    return {c: got[f"{c}_1"] / (got[f"{c}_1"] + 2 * got[f"{c}_2"]) if got[f"{c}_1"] else 0.5 for c in columns}


def _differences(counts: DataFrame, model: Model) -> None:
    """The tables of ``model`` from the counts of words and of labelled bigrams."""
    both = counts.where("gram = 2").select("v", "w", *CLASSES)
    d2 = _discount(both, CLASSES)
    kinds = [F.count(F.when(F.col(c) > 0, 1)).alias(c) for c in CLASSES]
    follows = keep(both.groupBy("w").agg(*kinds), "follows")
    d1 = _discount(follows, CLASSES)
    every = follows.agg(*[f(c).alias(f"{c}_{k}") for c in CLASSES for k, f in (("sum", F.sum), ("kinds", lambda c: F.count(F.when(F.col(c) > 0, 1))))]).first()
    n_all, n_kinds = counts.where("gram = 1").agg(F.sum("n"), F.count(F.lit(1))).first()
    shared = (F.col("n") + 0.5) / F.lit(n_all + 0.5 * (n_kinds + 1))
    left = lambda c, d: F.greatest(F.col(c) - F.lit(d), F.lit(0.0))

    # Of a class: what all words together have lost, by shared counts.
    # A class whose texts have one word each has no pairs of words, and nothing but these.
    held_all = {c: every[f"{c}_sum"] or 0 for c in CLASSES}
    rest = {c: d1[c] * every[f"{c}_kinds"] / held_all[c] if held_all[c] else 1.0 for c in CLASSES}
    single = follows.join(counts.where("gram = 1").select("w", "n"), "w")
    single = keep(single.select("w", (F.col("ordinary") + F.col("toxic")).alias("seen"), *[((left(c, d1[c]) / held_all[c] if held_all[c] else F.lit(0.0)) + rest[c] * shared).alias(c) for c in CLASSES]), "single")
    model.other = float(np.log(rest["toxic"] / rest["ordinary"]))

    # After a word that the class doesn't have, nothing is known but the word by itself.
    known = [x for c in CLASSES for x in (F.sum(c).alias(f"{c}_sum"), F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_kinds"))]
    passed = [F.when(F.col(f"{c}_sum") > 0, F.lit(d2[c]) * F.col(f"{c}_kinds") / F.col(f"{c}_sum")).otherwise(1.0).alias(f"{c}_rest") for c in CLASSES]
    before = keep(both.groupBy("v").agg(*known).select("v", *[f"{c}_sum" for c in CLASSES], *passed), "before")
    held = both.join(before, "v").join(single.withColumnsRenamed({c: f"{c}_word" for c in CLASSES}), "w")
    after = {c: F.when(F.col(f"{c}_sum") > 0, left(c, d2[c]) / F.col(f"{c}_sum")).otherwise(0.0) + F.col(f"{c}_rest") * F.col(f"{c}_word") for c in CLASSES}
    less = lambda a, b: (F.log(a) - F.log(b)).cast("float").alias("x")

    level = lambda n: F.least(F.floor(F.log2(n)) + 1, F.lit(LEVELS - 1)).cast("byte").alias("level")

    def table(df: DataFrame) -> list[np.ndarray]:
        got = df.toArrow()
        return [got.column(i).to_numpy() for i in range(got.num_columns)]

    w, x, n = table(single.select("w", less(F.col("toxic"), F.col("ordinary")), level(F.col("seen"))))
    v, passed_on = table(before.select("v", less(F.col("toxic_rest"), F.col("ordinary_rest"))))
    every = np.union1d(w, v)
    columns = [np.full(len(every), model.other, np.float32), np.zeros(len(every), np.uint8), np.zeros(len(every), np.float32)]
    columns[0][np.searchsorted(every, w)], columns[1][np.searchsorted(every, w)], columns[2][np.searchsorted(every, v)] = x, n, passed_on
    model.words = Table.of(every, *columns)
    seen = F.least(F.col("seen"), F.col("ordinary") + F.col("toxic"))
    v, w, x, n = table(held.select("v", "w", less(after["toxic"], after["ordinary"]), level(seen)))
    model.bigrams = Table.of(_pair(v, w), x, n.astype(np.uint8))
    for df in (follows, single, before):
        discard(df)


def _calibrate(model: Model, cells: np.ndarray, y: np.ndarray) -> None:
    """The evidence of each cell, from documents that the tables don't know, and a
    ridge logistic regression on it by Newton's method."""
    n = [cells[y == c].sum(axis=0).astype(np.float64) for c in (0, 1)]
    both = n[0].sum() + n[1].sum()
    # A word more in each cell, dealt to the classes as all words are.
    share = [(x + x.sum() / both) / max(x.sum(), 1.0) for x in n]
    model.evidence = np.log(share[1] / share[0]) if n[0].sum() and n[1].sum() else np.zeros(CELLS)
    x = model.features(cells)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    a, w = np.column_stack([(x - model.mean) / model.scale, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + 1e-2 * np.eye(len(w)), a.T @ (q - y) + 1e-2 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    model.weights = w


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "toxicity", most: float | None = None) -> DataFrame:
    """``docs`` with the column ``name``, each text's score from 0 to 1; with
    ``most``, only rows that score less. A text without words has the share of
    toxic documents as its score. A column of that name, in whatever case, is replaced."""
    small_batches(docs.sparkSession)
    tables = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c.lower() != name.lower()]
    rows = docs.select(*rest)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.pieces(batches, text_col):
            s = scores(batch.column(text_col), tables.value)
            out = pa.record_batch([*batch.columns, pa.array(s)], names=[*batch.schema.names, name])
            yield out if most is None else out.filter(pa.array(s < most))

    return rows.mapInArrow(tokens.tidy(run), schema)
