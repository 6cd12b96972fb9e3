"""Repeated passages against a table of all windows."""

import random
import re

import numpy as np
import pytest

from isoptic.llm import substring


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words):
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                least[k] = min(least.get(k, d), d)
    out = []
    for (d, t), w in zip(rows, words):
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - window + 1):
                if least[tuple(w[i : i + window])] < d:
                    gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def corpus(seed, window):
    r = random.Random(seed)
    word = lambda: f"{'Ww'[r.random() < 0.1]}{int(r.paretovariate(0.7)) % 60}"
    passages = [[word() for _ in range(r.randint(window - 1, 3 * window))] for _ in range(6)]
    rows = []
    for d in range(70):
        t = [word() for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            t[r.randint(0, len(t)) :] = p[r.randint(0, 5) :] if r.random() < 0.5 else p
            t += [word() for _ in range(r.randint(0, 9))]
        rows.append((d, r.choice([" ", "\n", "\t "]).join(t)))
    rows += [(200 + i, rows[i][1]) for i in range(0, 30, 3)] + [(300, "again " * 400), (301, "again " * 300), (302, "a b " * 100), (5, rows[7][1]), (6, rows[6][1]), (400, None), (401, ""), (None, rows[8][1]), (402, "é" * 50_000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "window", "gram", "hot"), [(0, 12, 5, 2000), (1, 12, 5, 1), (2, 50, 20, 2000), (3, 16, 8, 3)])
def test_against_all_windows(spark, seed, window, gram, hot, monkeypatch):
    monkeypatch.setattr(substring, "INDEX_WORDS", 2000 if seed % 2 else 1_000_000)
    rows = corpus(seed, window)
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "doc_id long, text string, n_words int, id int, _lost int").repartition(3)
    got = substring.without_repeats(df, window=window, gram=gram, hot=hot).collect()
    assert [c for c in got[0].__fields__ if c in ("id", "_lost")] == ["id", "_lost"]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == brute(rows, window)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring.without_repeats(df).count() == 0


def test_wavelet_matrix_counts():
    r = np.random.default_rng(0)
    for kinds in (1, 2, 5, 300):
        text = r.integers(0, kinds, 1000)
        m = substring.WaveletMatrix(text, kinds)
        c, i = r.integers(0, kinds, 200), r.integers(0, 1001, 200)
        assert m.rank(c, i).tolist() == [int((text[:b] == a).sum()) for a, b in zip(c, i)]


def test_what_follows_the_input_is_not_broadcast(spark):
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{words} {i}") for i in range(4)], "doc_id long, text string")
    from isoptic.llm import substring as sub

    got = sub.without_repeats(docs)
    assert sorted((r.doc_id, r.n_removed) for r in got.collect()) == [(0, 0), (1, 60), (2, 60), (3, 60)]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
