"""Toxicity: held-out accuracy, and Kneser-Ney worked out by hand."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isoptic.llm import toxicity
from isoptic.llm.queries import op1_toxicity


def corpus(n=3000, seed=0):
    r = random.Random(seed)
    plain = [f"w{i}" for i in range(400)]
    rude = ["Vile!", "rotten", "wretch,"]
    docs, labels = [], []
    for d in range(n):
        t = [r.choice(plain) for _ in range(r.randint(5, 80))]
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(r.randint(1, 3)):
                t.insert(r.randrange(len(t)), r.choice(rude))
        docs.append((d, " ".join(t)))
        if d % 2:
            labels.append((d, int(toxic)))
    docs += [(9001, None), (9002, ""), (9003, "vile " * 20_000), (9004, docs[3][1]), (None, "wretch, rotten vile")]
    return docs, [*labels, (None, 1), (2, None), (5, labels[2][1])]


def test_held_out(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, k string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, lab)
    got = toxicity.score(d, model, name="score").withColumn("f", toxicity.fold("doc_id")).collect()
    assert len(got) == len(docs) and all(0 <= g.score <= 1 for g in got)
    truth = dict((x, t) for x, t in labels if t is not None)
    out = [(g.score >= 0.5, truth[g.doc_id]) for g in got if g.doc_id in truth and g.f == 0]
    assert len(out) > 50 and sum(a == bool(b) for a, b in out) / len(out) > 0.97
    by = {g.doc_id: g.score for g in got}
    assert by[9003] > 0.5 and by[None] > 0.5 and by[9001] == by[9002] == model.prior
    left = toxicity.score(d, model, name="k", most=0.5)
    assert left.columns == ["doc_id", "text", "k"] and left.count() == sum(g.score < 0.5 for g in got)
    # Labels of the held-out fold change nothing.
    other = lab.withColumn("toxic", F.when(toxicity.fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(d, other)
    assert np.array_equal(again.weights, model.weights) and np.array_equal(again.bigrams.columns[0], model.bigrams.columns[0])


def test_small_corpus(spark):
    got = op1_toxicity(spark, "/root/testdata/sf0.1")
    joined = got.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(g.predicted == g.toxic for g in joined) / len(joined) > 0.97


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1)]])
def test_without_classes(spark, labels):
    d = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(d, toxicity.fit(d, lab)).collect()
    assert len({round(g.toxicity, 6) for g in got}) == 1
    assert toxicity.score(d.limit(0), toxicity.fit(d.limit(0), lab)).count() == 0


def plain(text):
    words = [w.lower() if len(w) < 2 else w.lower().strip("".join(c for c in map(chr, range(33, 127)) if not c.isalnum())) for w in (text or "").split()]
    return words


def kneser_ney(corpus, texts):
    """P(word | before) of a class, from its ``texts`` and the whole corpus."""
    pairs, n = Counter(), Counter()
    for t in corpus:
        n.update(plain(t))
    for t in texts:
        w = plain(t)
        pairs.update(zip(w, w[1:]))

    def discount(counts):
        n1, n2 = (sum(c == k for c in counts) for k in (1, 2))
        return n1 / (n1 + 2 * n2) if n1 else 0.5

    d2 = discount(pairs.values())
    follows = Counter(w for _, w in pairs)
    d1 = discount(follows.values())
    after = defaultdict(dict)
    for (v, w), c in pairs.items():
        after[v][w] = c

    def word(w):
        shared = (n[w] + 0.5) / (sum(n.values()) + 0.5 * (len(n) + 1))
        kinds = sum(follows.values())
        return max(follows[w] - d1, 0) / kinds + d1 * len(follows) / kinds * shared

    def given(w, v):
        if v not in after:
            return word(w)
        total = sum(after[v].values())
        return max(after[v].get(w, 0) - d2, 0) / total + d2 * len(after[v]) / total * word(w)

    return word, given


def test_differences_are_kneser_ney(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(25)]
    rude = ["vile", "rotten", "Wretch!"]
    docs, labels = [], []
    for d in range(200):
        toxic = d % 3 == 0
        t = [r.choice(words + rude * (4 if toxic else 0)) for _ in range(r.randint(1, 14))]
        docs.append((d, " ".join(t) + f" only{d}"))
        if d < 150:
            labels.append((d, int(toxic)))
    docs += [(500, "never labelled words here"), (501, None)]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int"))
    fold = lambda d: zlib.crc32(str(d).encode()) % toxicity.FOLDS
    text = dict(docs)
    used = {c: [text[d] for d, y in labels if y == c and fold(d) not in (toxicity.HELD_OUT, toxicity.CALIBRATE)] for c in (0, 1)}
    ordinary, toxic = (kneser_ney(text.values(), used[c]) for c in (0, 1))
    asked = [*text.values(), "vile vile unseen w1 w2", "unseen"]
    w, first = toxicity._words(pa.array(asked))
    got, level = model.differences(w, first)
    want, levels = [], []
    follows, pairs = Counter(), Counter()
    for c in (0, 1):
        own = Counter(p for t in used[c] for p in zip(plain(t), plain(t)[1:]))
        pairs += own
        follows += Counter(w for _, w in own)
    for t in asked:
        own = plain(t)
        for v, x in zip([None, *own], own):
            want.append(math.log(toxic[0](x) / ordinary[0](x)) if v is None else math.log(toxic[1](x, v) / ordinary[1](x, v)))
            levels.append(min(7, min(follows[x], pairs[v, x] or follows[x]).bit_length()))
    assert np.abs(got - np.array(want)).max() < 1e-5 and level.tolist() == levels
    # A score doesn't depend on the batch that a text is in.
    whole = toxicity.scores(pa.array(asked), model)
    assert [toxicity.scores(pa.array([t], pa.string()), model)[0] for t in asked] == whole.tolist()
    # Length-normalised evidence, of the whole text and at its highest.
    x = model.features(toxicity.histogram(pa.array(asked), model))
    worth = model.evidence[level * 12 + np.clip(np.floor(got).astype(int) + 6, 0, 11)]
    for k, (a, b) in enumerate(zip(first[:-1], first[1:])):
        assert x[k].tolist() == pytest.approx([worth[a:b].mean(), worth[a:b].max(), math.log1p(b - a)] if b > a else [0, 0, 0])


def test_table():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 1000):
        key = r.integers(0, 1 << 64, n, dtype=np.uint64) >> np.uint64(r.choice([0, 3]))
        key = np.unique(key)
        t = toxicity.Table.of(key[::-1].copy(), np.arange(len(key))[::-1].copy())
        asked = np.concatenate([key, r.integers(0, 1 << 64, 50, dtype=np.uint64)])
        hit, at = t.find(asked)
        assert t.columns[0][at].tolist() == [i for i in np.searchsorted(key, asked[hit]).tolist()] and set(asked[hit].tolist()) == set(key.tolist())
        assert not len(toxicity.Table().find(asked)[0])


def test_words():
    h, first = toxicity._words(pa.array(["Vile! (vile) v.", None, "!!"]))
    assert h[0] == h[1] and first.tolist() == [0, 3, 3, 4]


@pytest.mark.parametrize("short", ["both", "toxic", "ordinary"])
def test_classes_of_texts_with_one_word(spark, short):
    rows, labels = [], []
    for i in range(600):
        toxic = i % 2
        word = f"bad{i % 5}" if toxic else f"good{i % 7}"
        one = short == "both" or short == ("toxic" if toxic else "ordinary")
        rows.append((i, f"{word}{i}" if one and i % 3 else word if one else f"{word} is what this number {i} says"))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    assert len(got) == 600 and all(0 <= x <= 1 for x in got.values())
    if short != "both":
        assert sum((got[i] >= 0.5) == i % 2 for i in got) > 500


def test_a_column_of_that_name_in_another_case_is_replaced(spark):
    docs = spark.createDataFrame([(1, "a b", 9, "x")], "doc_id long, text string, Toxicity int, other string")
    out = toxicity.score(docs, toxicity.Model(prior=0.5))
    assert out.columns == ["doc_id", "text", "other", "toxicity"] and out.first().toxicity == 0.5
