"""Exact and line de-duplication, and mixing, against plain loops."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from isoptic.llm import exact, lines, mixing


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def rows_of(seed):
    r = random.Random(seed)
    base = ["", None, "É Straße İ Ⅷ ΑΣ", "Same Text", "sAME tEXT", "x" * 30_000, " ", "same text "] + [f"t{i}" for i in range(5)]
    return [(r.choice([None, *range(40)]) if r.random() < 0.1 else i, r.choice(base)) for i in range(120)]


@pytest.mark.parametrize(("seed", "weak"), [(0, False), (1, True)])
def test_exact(spark, seed, weak, monkeypatch):
    monkeypatch.setattr(exact, "HOT", 3 if seed else 10_000)
    rows = rows_of(seed)
    df = spark.createDataFrame([(*x, "e") for x in rows], "doc_id long, text string, digest string").repartition(4)
    options = {"digest": lambda t: F.length(t).cast("string")} if weak else {}
    got = exact.exact_duplicates(df, **options).collect()
    groups = defaultdict(list)
    for d, t in rows:
        groups[low(t)].append(d)
    best = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    digest = (lambda t: str(len(t))) if weak else (lambda t: hashlib.sha256(t.encode()).hexdigest())
    want = [(d, digest(low(t)), best[low(t)] if len(groups[low(t)]) > 1 else d, len(groups[low(t)]), d == best[low(t)] or len(groups[low(t)]) == 1) for d, t in rows]
    assert sorted(map(str, (tuple(g[c] for c in ("id", "digest", "keep_id", "group_size", "kept")) for g in got))) == sorted(map(str, want))
    assert exact.exact_duplicates(df.limit(0)).count() == 0


def brute_lines(rows, least=20, docs=3):
    held = defaultdict(set)
    key = lambda line: low(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))
    for d, t in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= least:
                    held[key(line)].add(d)
    out = []
    for d, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if d is None or not (len(held.get(key(x), ())) >= docs and max(held[key(x)]) != d)]
        out.append((str(d), len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_lines(spark):
    r = random.Random(3)
    pool = ["A repeated line that is long", "  a REPEATED line that is long\t", "short", "", "ÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ", "É" * 19, "unique enough but in two only"] + [f"filler line number {i:05d} xx" for i in range(30)]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 12)))) for i in range(60)]
    rows += [(5, "A repeated line that is long\nother"), (6, rows[6][1]), (None, rows[1][1]), (70, None), (71, "\n\n"), (72, "\n".join(["A repeated line that is long"] * 3000))]
    df = spark.createDataFrame([(*x, 1, 2, 3, 4, 5) for x in rows], "doc_id long, text string, n_lines int, _gone int, id int, _th int, own_th int").repartition(4)
    assert lines.repeated_lines(df).columns == [c for c in df.columns if c != "n_lines"] + ["line_text", "n_lines", "n_dropped"]
    got = lines.repeated_lines(df).collect()
    assert sorted((str(g.doc_id), g.n_lines, g.n_dropped, g.line_text) for g in got) == brute_lines(rows)
    assert lines.repeated_lines(df.limit(0)).count() == 0


def fill(sizes, weights, share=1.5, cap=2.0):
    total, out, left = share * sum(sizes.values()), {}, dict(weights)
    while True:
        level = (total - sum(out.values())) / sum(left.values())
        full = [k for k in left if level * left[k] > cap * sizes[k]]
        if not full:
            return out | {k: level * w for k, w in left.items()}
        for k in full:
            out[k] = cap * sizes[k]
            del left[k]


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    r = random.Random(seed)
    names = ["b", "a", "é", "Z", None, "empty"][: 4 + seed]
    rows = [(i, r.choice(names[:2]) if r.random() < 0.5 else r.choice(names), " ".join("w" * r.randint(0, 80))) for i in range(400)]
    rows = [(d, s, None if s == "empty" else t) for d, s, t in rows] + [(7, "a", "x y"), (None, "b", "x y z")]
    df = spark.createDataFrame([(*x, 1, 2, 3, 4) for x in rows], "doc_id long, source string, text string, size int, copies int, copy int, id int").repartition(4)
    got = mixing.mixture(df).collect()
    assert sorted(map(str, mixing.mixture(df, slice_rows=1).collect())) == sorted(map(str, got))
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += n(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    taken = defaultdict(int)
    for g in got:
        assert g.source_size == sizes[g.source] and abs(g.target - target[g.source]) < 1e-6 * (1 + target[g.source]) and g.taken <= 2 * g.size
        taken[g.source] += g.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 45 for s in sizes)
    assert sorted(map(str, mixing.mixture(df.repartition(7)).collect())) == sorted(map(str, got))
    copies = defaultdict(int)
    for g in got:
        copies[g.id] = max(copies[g.id], g.copies)
    assert mixing.mix(df).count() == sum(copies[d] for d, _, _ in rows) and mixing.mix(df).columns == df.columns
    assert mixing.mixture(df.limit(0)).count() == 0


def test_copies_are_combined_before_texts_move(spark, monkeypatch):
    plans, kept = {}, exact.keep

    def keep(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString().splitlines()
        return kept(df, name)

    monkeypatch.setattr(exact, "keep", keep)
    exact.exact_duplicates(spark.createDataFrame([(1, "a"), (2, "A")], "doc_id long, text string")).collect()
    dealt = max(i for i, x in enumerate(plans["exact"]) if "Exchange hashpartitioning(digest" in x and "salt" in x)
    assert any("partial_max(id" in x for x in plans["exact"][dealt:])
