"""Decontamination against an alignment of everything with everything."""

import random
import re

import numpy as np

from isoptic.llm import decontam


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))


def sw(a, b):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


def brute(docs, items):
    return {(d, i, round(s, 9)) for d, t in docs for i, b in items if words(b) and words(t) and (s := sw(words(b), words(t)) / (2 * len(words(b)))) >= 0.5}


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["the"] * 40
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(12, 40)))) for i in range(8)]
    docs = []
    for d in range(60):
        own = [r.choice(vocab) for _ in range(r.randint(0, 120))]
        if d % 2:
            copy = items[d % 8][1].split()
            for _ in range(len(copy) // 10 if d % 3 else 0):
                k = r.randrange(len(copy))
                copy[k : k + 1] = r.choice([[], ["new"], [copy[k], "more"]])
            at = r.randint(0, len(own))
            own[at:at] = copy
        docs.append((d, " ".join(own).upper() if d % 5 == 0 else " ".join(own)))
    return docs, items


def test_against_all_alignments(spark):
    for seed in range(3):
        docs, items = corpus(seed)
        d = spark.createDataFrame([(*x, "e") for x in docs], "doc_id long, text string, score string").repartition(3)
        b = spark.createDataFrame(items, "item_id long, text string")
        for block in (1_000_000, 60):
            got = decontam.contaminated(d, b, block_words=block).collect()
            assert {(r.doc_id, r.item_id, round(r.score, 9)) for r in got} == brute(docs, items)
        text = dict(docs)
        item = dict(items)
        for r in got:
            assert sw(words(item[r.item_id]), words(text[r.doc_id])[r.start : r.stop]) / (2 * len(words(item[r.item_id]))) == r.score
        kept = {r.doc_id for r in decontam.clean(d, b).collect()}
        assert kept == set(text) - {x[0] for x in brute(docs, items)}


def test_align_is_smith_waterman():
    r = np.random.default_rng(1)
    for _ in range(50):
        a, b = r.integers(1, 5, 9).astype(np.uint64), r.integers(0, 5, (3, 20)).astype(np.uint64)
        best, _ = decontam.align(a, b)
        assert best.tolist() == [sw(a.tolist(), x.tolist()) for x in b]


def test_hot_nulls_short_and_empty(spark):
    items = [(1, "one two three four five six seven"), (2, None), (3, ""), (4, "single"), (5, "one two three four five six seven")]
    docs = [(k, "x y one two three four five six seven z") for k in range(200)] + [(500, None), (501, ""), (502, "single " * 30000), (None, "a single b"), (7, "single")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(d, b).collect()
    assert len([r for r in got if r.item_id in (1, 5) and r.score == 1.0]) == 400
    assert sorted((str(r.doc_id)) for r in got if r.item_id == 4) == ["502", "7", "None"]
    assert decontam.contaminated(d.limit(0), b).count() == 0 and decontam.contaminated(d, b.limit(0)).count() == 0


def test_many_documents_with_one_edited_passage(spark):
    item = [f"w{k}" for k in range(40)]
    edited = " ".join("new" if k % 4 == 3 else x for k, x in enumerate(item))
    docs = [(k, f"a{k} b{k} {edited} c{k}") for k in range(3000)] + [(5000 + k, f"w0 w1 w2 and d{k} other words") for k in range(3000)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    score = sw(item, edited.split()) / 80
    assert score >= 0.5
    got = decontam.contaminated(d, b).collect()
    assert {(r.doc_id, r.score) for r in got} == {(k, score) for k in range(3000)}


def test_rows_are_judged_by_themselves(spark):
    item = "one two three four five six seven"
    docs = [(None, f"x {item} y", 1), (None, "clean text without it", 2), (3, f"{item}", 3), (3, "another text of that id", 4), (4, None, 5)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int").repartition(2)
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontam.clean(d, b)
    assert got.columns == d.columns and sorted(r.item_id for r in got.collect()) == [2, 4, 5]
    assert decontam.clean(d, b.limit(0)).count() == 5 and decontam.clean(d.limit(0), b).count() == 0


def test_a_long_item(spark, monkeypatch):
    sizes = []
    align = decontam.align
    monkeypatch.setattr(decontam, "align", lambda item, windows: sizes.append(windows.size) or align(item, windows))
    long = [f"w{k}" for k in range(4000)]
    items = decontam._items([(1, " ".join(long))])
    texts = decontam.pa.array([" ".join(long[: 2500 + k]) for k in range(60)])
    got = decontam._hits(items, texts, 0.5)
    assert {r for r, _ in got} == set(range(60)) and max(sizes) <= decontam.CELLS


def test_seeds_a_few_at_a_time(spark, monkeypatch):
    w = decontam.tokens.words(decontam.pa.array(["a b c a b c d", "x a b c"]))
    items = decontam._items([(1, "a b c"), (2, "z a b c d")])
    whole = [np.concatenate(x) for x in zip(*decontam._places(items, w, items.sizes))]
    monkeypatch.setattr(decontam, "SEEDS", 2)
    parts = list(decontam._places(items, w, items.sizes))
    assert len(parts) > 1
    assert [np.concatenate(x).tolist() for x in zip(*parts)] == [x.tolist() for x in whole]
