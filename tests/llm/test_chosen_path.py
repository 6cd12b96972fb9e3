import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isoptic.llm import chosen_path


def shingles(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def plain(rows):
    """id to (n_shingles, component_id), by all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    top = list(range(len(rows)))

    def up(x):
        while top[x] != x:
            x = top[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                top[up(x)] = up(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[up(x)] = min(i, least.get(up(x), i))
    return {i: (len(a), least[up(x)]) for x, (i, a) in enumerate(sets)}


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return out


def family(r, size, length, edits, common=()):
    base = [f"w{r.randrange(3000)}" for _ in range(length)]
    return [" ".join([*common, *edited(r, base, r.randrange(edits + 1))]) for _ in range(size)]


def check(spark, texts, **how):
    rows = list(enumerate(texts))
    got = {x.id: x for x in chosen_path.similar(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()}
    want = plain(rows)
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == want
    assert all(x.kept == (x.id == x.component_id) for x in got.values())


def test_components_are_those_of_all_pairs(spark):
    r = random.Random(3)
    texts = ["", None, " \n", "One two", "one TWO", "one two three", "a b c d", "A B C D", "a b c d e"]
    passage = [f"p{i}" for i in range(40)]
    for _ in range(25):
        texts += family(r, r.randrange(1, 7), r.randrange(5, 160), 6)
    for _ in range(120):  # a passage that many texts share
        texts += family(r, 1, r.randrange(30, 90), 0, passage)
    r.shuffle(texts)
    check(spark, texts)


def test_a_large_family_beside_others_much_like_it(spark, monkeypatch):
    """Nodes over one block, components over one block, and pairs just below the threshold."""
    monkeypatch.setattr(chosen_path, "BLOCK", 16)
    monkeypatch.setattr(chosen_path, "WIDE", 8)
    r = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(edited(r, base, r.randrange(4))) for _ in range(70)]
    for k in range(25):  # half of these words, so they share half and aren't links
        texts.append(" ".join(base[:80] + [f"o{k}x{i}" for i in range(40)]))
    texts += [" ".join(edited(r, base, 5)) for _ in range(25)]
    r.shuffle(texts)
    check(spark, texts)


def test_a_chain_is_one_component(spark):
    words = [f"c{i}" for i in range(400)]
    check(spark, [" ".join(words[k * 6 : k * 6 + 100]) for k in range(40)])


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_trees_miss_as_few_links_as_they_say(spark, depth):
    """Pairs of exactly the threshold, through branches alone."""
    r = np.random.default_rng(depth)
    both = r.integers(0, 2**63, (2000, 80), dtype=np.uint64)
    alone = r.integers(0, 2**63, (2000, 2, 10), dtype=np.uint64)
    x, y = (np.concatenate([both, alone[:, k]], axis=1) for k in (0, 1))
    starts = np.arange(0, 2000 * 90, 90)
    a, b = (chosen_path.minwise(v.ravel(), starts) for v in (x, y))
    assert abs((a == b).mean() - 0.8) < 0.01
    trees, met = 3, np.zeros(2000, bool)

    def paths(mins):
        got = [set() for _ in range(2000)]
        for batch in chosen_path._rooted(iter([batch_of(mins)])):
            for key, s in zip(batch.column("key").to_pylist(), batch.column("s").to_pylist(), strict=True):
                got[s].add(key)
        return got

    def batch_of(mins, s=None, key=None):
        s = np.arange(len(mins)) if s is None else s
        columns = {"s": pa.array(s), "mins": pa.array([m.tobytes() for m in mins], pa.binary())} | ({} if key is None else {"key": pa.array(key)})
        return pa.record_batch(list(columns.values()), names=list(columns))

    odd = chosen_path._constants(chosen_path.TREES, 300)
    for t in range(trees):
        now = []
        for mins in (a, b):
            key, s = chosen_path.tokens.mix64(mins[:, t] + odd[t]).view(np.int64), np.arange(2000)
            for _ in range(depth):
                out = list(chosen_path._branched(iter([batch_of(mins[s], s, key)])))
                key, s = (np.concatenate([o.column(c).to_numpy() for o in out]) for c in ("key", "s"))
            now.append(set(zip(key.tolist(), s.tolist(), strict=True)))
        met[[s for _, s in now[0] & now[1]]] = True
    expected = chosen_path.missed(0.8, depth, trees)
    assert (~met).mean() < expected + 0.03
    assert chosen_path.missed(0.8, 0) < 1e-13 and chosen_path.missed(0.8, 10) < 1e-5 and chosen_path.missed(0.9, 10) < 1e-9


def test_sketches_keep_linked_pairs():
    r = np.random.default_rng(2)
    for size in (1, 4, 30, 200, 2000):
        x = np.sort(r.integers(0, 2**63, (400, size), dtype=np.uint64) * np.uint64(2), axis=1)
        y = x.copy()
        gone = size // 9  # the largest part that can differ: (size - g) / (size + g) >= 0.8
        y[:, :gone] = r.integers(0, 2**63, (400, gone), dtype=np.uint64)
        y = np.sort(y, axis=1)
        rows = np.repeat(np.arange(400), size)
        plain = [chosen_path.sketches(v.ravel(), rows, 400) for v in (x, y)]
        a, b = map(chosen_path.packed, plain)
        same = chosen_path.alike(a, b, np.full(400, size), np.full(400, size))[0]
        assert (same == ((plain[0] == plain[1]) & (plain[0] > 0)).sum(axis=1)).all()
        n = np.full(400, size)
        assert chosen_path.alike(a, b, n, n)[1].all()
        if size >= 200:
            other = chosen_path.packed(chosen_path.sketches(np.sort(r.integers(0, 2**64 - 1, (400, size), dtype=np.uint64), axis=1).ravel(), rows, 400))
            assert not chosen_path.alike(a, other, n, n)[1].any()


def test_nulls_repeats_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text, 1), (3, text, 2), (3, text, 3), (2, text + " end", 4), (None, "x y z a b c", 5), (None, "x y z a b c", 6), (None, None, 7), (9, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, s long")
    got = sorted(((r.id or -1, r.component_id or -1, r.n_shingles, r.kept) for r in chosen_path.similar(docs).collect()))
    assert got == sorted([(-1, 2, 47, False), (3, 2, 47, False), (3, 2, 47, False), (2, 2, 48, True), (-1, -1, 3, True), (-1, -1, 3, True), (-1, -1, 0, True), (9, 9, 0, True)])
    assert chosen_path.similar(docs.limit(0)).collect() == []
    assert chosen_path.similar(docs.where(F.col("text").isNull())).count() == 2


def test_few_sets_are_not_dealt_to_as_many_tasks_as_the_session_shuffles_to(spark):
    entries = spark.range(4000).selectExpr("id % 100 as key", "id % 200 as s")
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(k) for k in names]
    try:
        for k, v in zip(names, ("211", "false")):
            spark.conf.set(k, v)
        asked = chosen_path._held_against(entries, None, 0, 4000)
        assert asked.rdd.getNumPartitions() <= chosen_path.LEAST
        assert chosen_path.components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).rdd.getNumPartitions() <= 2
    finally:
        for k, v in zip(names, before):
            spark.conf.set(k, v)
