"""The Jaccard join against every pair."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from isoptic.llm import components, jaccard


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def up(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[up(i)] = up(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[up(i)] = min(least.get(up(i), d), d)
    return sorted((d, len(s), least[up(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed):
    r = random.Random(seed)
    word = lambda: f"w{int(r.paretovariate(0.5)) % 400}"
    line = [word() for _ in range(30)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(r.choice([3, 8, 20, 60, 150]))]
        if r.random() < 0.5:
            base[r.randrange(len(base)) :] = line
        for _ in range(r.randint(1, 9)):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 25))):
                k = r.randrange(len(t) + 1)
                t[k : k + r.randint(0, 1)] = r.choice([[], [word()], [word(), word()]])
            texts.append(" ".join(t))
            base = t if r.random() < 0.4 else base  # chains too
    texts += ["", None, " \t", texts[0].upper(), "a b c", "A B\nC", "a b c d"]
    r.shuffle(texts)
    ids = r.sample(range(1000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed", range(2))
def test_against_every_pair(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST", 0 if seed % 2 else 1_000_000)
    rows = corpus(seed)
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n_shingles int").repartition(3)
    got = sorted((r.id, r.n_shingles, r.component_id) for r in jaccard.similar(df).collect())
    assert got == brute(rows)
    if seed:
        assert {r.doc_id for r in jaccard.one_of_each(df).collect()} == {c for _, _, c in got}


def test_without_frequent_and_with_copies(spark):
    base = " ".join(f"x{i}" for i in range(200))
    rows = [(i, base + f" y{i}") for i in range(120)] + [(200 + i, base) for i in range(50)] + [(300, base), (300, base), (None, base), (None, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard.similar(df).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.n_shingles > 1} == {0}
    assert [r.component_id for r in got if r.n_shingles == 1] == [None]
    assert jaccard.similar(df.limit(0)).count() == 0


@pytest.mark.parametrize("edges", [200_000, 20])
def test_components(spark, edges, monkeypatch):
    monkeypatch.setattr(components, "EDGES", edges)
    monkeypatch.setattr(components, "HUB", 4)
    r = random.Random(5)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, 200 + i) for i in range(80)]
    some = [(1000 + r.randrange(60), 1000 + r.randrange(60)) for _ in range(45)]
    pairs = [(b, a) if r.random() < 0.5 else (a, b) for a, b in chain + star + some]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    least = {x: x for p in pairs for x in p}
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    alone = {x for x in least if all(a == b for a, b in pairs if x in (a, b))}
    assert got == {k: v for k, v in least.items() if k not in alone}


def entries(sets):
    """Prefix entries of sets, in the order of their hashes."""
    out = []
    for x in sets:
        n = len(x)
        p = int(jaccard._prefix(np.int64(n)))
        e = np.empty(p, jaccard.ENTRY)
        e["v"], e["s"], e["n"], e["p"] = np.sort(x)[:p], jaccard._name(x), n, np.arange(p)
        out.append(e)
    return np.concatenate(out)


def made_sets(seed):
    """Families of sets around a base, some members far from it, and others."""
    r = np.random.default_rng(seed)
    draw = lambda n: r.integers(0, 1 << 62, n).astype(np.uint64)
    sets = []
    for _ in range(4):
        base = draw(int(r.integers(40, 160)))
        for _ in range(int(r.integers(5, 45))):
            gone, more = int(len(base) * r.choice([0.02, 0.05, 0.13, 0.2])), int(r.integers(0, 12))
            sets.append(np.unique(np.concatenate([r.permutation(base)[gone:], draw(more)])))
    return [*sets, *[draw(60) for _ in range(10)]]


def similarity(x, y):
    both = len(np.intersect1d(x, y))
    return both / (len(x) + len(y) - both)


@pytest.mark.parametrize("seed", range(3))
def test_blocks_make_the_pairs_that_positions_allow(seed):
    e, first = jaccard._lists([entries(made_sets(seed)).tobytes()])
    got = [tuple(sorted(p)) for i, k in jaccard._block_pairs(e, first) for p in zip(i.tolist(), k.tolist())]
    every = [(i, k) for a, b in zip(first[:-1], first[1:]) for k in range(a, b) for i in range(a, k)]
    allowed = {p for p, ok in zip(every, jaccard._may(e[[i for i, _ in every]], e[[k for _, k in every]])) if ok}
    assert len(got) == len(set(got)) and allowed <= set(got)
    # What is made and not allowed is little: sizes within a block differ by a ninth.
    assert len(got) < 1.5 * len(allowed) + 100


def test_a_long_list_is_skipped_in_blocks():
    e = np.empty(4000, jaccard.ENTRY)
    e["v"], e["s"], e["n"], e["p"] = 7, np.arange(4000), 4000, np.arange(4000) * 7 % 1000
    first = jaccard._firsts(e["v"])
    e = e[np.lexsort((e["s"], e["p"], e["v"]))]
    made = sum(len(i) for i, _ in jaccard._block_pairs(e, first))
    e["n"] = 400
    fewer = sum(len(i) for i, _ in jaccard._block_pairs(e, first))
    # Positions may differ by a seventh of the size: of 400 far fewer pairs are made.
    assert fewer < 0.15 * 4000 * 3999 / 2 < made


@pytest.mark.parametrize("seed", range(6))
def test_answers_of_a_first_set_lose_no_link(seed, monkeypatch):
    monkeypatch.setattr(jaccard, "HEAVY", 4)
    monkeypatch.setattr(jaccard, "PAIRS", 300 if seed % 2 else 500_000)
    sets = {jaccard._name(x): x for x in made_sets(seed)}
    names = sorted(sets)
    r = random.Random(seed)
    root = {}
    for a in names:  # components: some links, as rounds find them
        near = [b for b in names if b < a and b not in root and similarity(sets[a], sets[b]) >= 0.75]
        if near and r.random() < 0.9:
            root[a] = near[0]
    own = {a: root.get(a, a) for a in names}
    e = entries(list(sets.values()))
    shared = {}
    held, first = jaccard._lists([e.tobytes()])
    for s in held["s"].tolist():
        shared[s] = shared.get(s, 0) + 1
    lists = pa.table({"part": pa.array([5]), "blob": pa.array([e.tobytes()], pa.binary())})
    there = sorted(shared)
    table = pa.table({"part": [5] * len(there), "s": there, "t": [shared[s] for s in there], "root": [own[s] for s in there]})
    asked = jaccard._asked(lists, table)
    pairs = list(zip(asked.column("a").to_pylist(), asked.column("b").to_pylist()))
    assert pairs and len(pairs) == len(set(pairs))
    o = [len(np.intersect1d(sets[a], sets[b])) for a, b in pairs]
    answers = pa.table({"part": [5] * len(pairs), "s": [b for _, b in pairs], "t": [len(sets[a]) for a, _ in pairs], "root": [a for a, _ in pairs], "o": o, "lost": [np.setdiff1d(sets[a], sets[b]).tobytes() for a, b in pairs], "more": [np.setdiff1d(sets[b], sets[a]).tobytes() for a, b in pairs]})
    for name, kind in (("o", pa.int64()), ("lost", pa.binary()), ("more", pa.binary())):
        table = table.append_column(name, pa.nulls(len(there), kind))
    known = pa.concat_tables([table, answers])
    out = jaccard._last_pairs(3)(lists, known)
    e = np.concatenate([np.frombuffer(x, jaccard.PAIR) for x in out.column("blob").to_pylist()] or [np.zeros(0, jaccard.PAIR)])
    count = {}
    for a, b, c in zip(e["a"].tolist(), e["b"].tolist(), e["c"].tolist()):
        count[a, b] = count.get((a, b), 0) + c
    least = lambda a, b: int(jaccard._least(np.int64(len(sets[a])), np.int64(len(sets[b]))))
    tested = {p for p, c in count.items() if c >= least(*p)}
    sure = {p for p, c in count.items() if c >= jaccard.CERTAIN}
    links = {(a, b) for i, b in enumerate(names) for a in names[:i] if similarity(sets[a], sets[b]) >= 0.75}
    assert sure <= links and all(own[a] != own[b] for a, b in count)
    joined = {tuple(sorted((own[a], own[b]))) for a, b in tested & links}
    assert {tuple(sorted((own[a], own[b]))) for a, b in links if own[a] != own[b]} <= joined
    # What follows from a first set's answers to both isn't asked for again.
    by = {}
    for a, b in pairs:
        by.setdefault(a, set()).add(b)
    assert not [p for p in tested - links if any(p[0] in x and p[1] in x for x in by.values())]


def test_documents_without_an_id(spark):
    base = " ".join(f"x{i}" for i in range(60))
    other = " ".join(f"z{i}" for i in range(60))
    rows = [(1, base), (None, base + " y"), (None, "alone in the whole of it"), (None, "two equal texts of some words"), (None, "two equal texts of some words")]
    rows += [(None, f"{other} {'q' * i}") for i in range(1, 4)] + [(None, ""), (None, None), (2, "of its own")]
    df = spark.createDataFrame([("e", *x) for x in rows], "more string, doc_id long, text string").repartition(3)
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns
    texts = [r.text for r in got.collect()]
    linked = [t for t in texts if t and t.startswith(other)]
    assert len(linked) == 1
    assert sorted(t or "" for t in texts if t not in linked) == sorted(["", "", base, "alone in the whole of it", "two equal texts of some words", "of its own"])


def test_documents_without_an_id_alone(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "d e f")], "doc_id long, text string")
    assert sorted(r.text for r in jaccard.one_of_each(df).collect()) == ["a b c", "d e f"]


def test_columns_of_any_name_beside_null_ids(spark):
    text = "one two three four five six seven"
    rows = [(None, text, 1, "p"), (None, text, 2, "q"), (4, "a b c d e f", 3, "r"), (None, None, 4, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _s long, own_s string").withColumn("_id", F.lit(5))
    got = jaccard.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, ""), (0, text), (4, "a b c d e f")]


@pytest.mark.parametrize("bits", [1 << 20, 0])
@pytest.mark.parametrize("twice", [False, True])
def test_marks_count_what_sets_share(bits, twice, monkeypatch):
    monkeypatch.setattr(jaccard, "BITS", bits)
    monkeypatch.setattr(jaccard, "CHUNK", 64)
    r = np.random.default_rng(3)
    parts = [np.unique(r.integers(0, 300, int(n)).astype(np.uint64)) for n in r.integers(0, 40, 30)]
    p, q = (x.ravel() for x in np.meshgrid(np.arange(29), np.arange(30)))
    p = p + (p >= q)  # of two sets
    marks = jaccard.Marks(parts, twice)
    assert marks.both(p, q).tolist() == [len(np.intersect1d(parts[i], parts[k])) for i, k in zip(p, q)]
    assert jaccard.Marks([parts[0][:0]] * 2, twice).both(p[:1] * 0, q[:1] * 0 + 1).tolist() == [0]


def test_pairs_of_many_sets_far_from_a_first_one_are_not_held(monkeypatch):
    monkeypatch.setattr(jaccard, "HEAVY", 4)
    monkeypatch.setattr(jaccard, "PAIRS", 500)
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 62, 120).astype(np.uint64)
    sets = [np.unique(np.concatenate([r.permutation(base)[k:], r.integers(0, 1 << 62, k).astype(np.uint64)])) for k in [2] * 8 + [14] * 240]
    names = [jaccard._name(x) for x in sets]
    leader = min(names[:8])
    first = sets[names.index(leader)]
    lists = pa.table({"part": [5], "blob": pa.array([entries(sets).tobytes()], pa.binary())})
    e, _ = jaccard._lists(lists.column("blob").to_pylist())
    there, times = np.unique(e["s"], return_counts=True)
    table = pa.table({"part": [5] * len(there), "s": there, "t": times, "root": [leader if s in names[:8] else s for s in there.tolist()], "o": pa.nulls(len(there), pa.int64()), "lost": pa.nulls(len(there), pa.binary()), "more": pa.nulls(len(there), pa.binary())})
    answers = pa.table({"part": [5] * len(sets), "s": names, "t": [len(first)] * len(sets), "root": [leader] * len(sets), "o": [len(np.intersect1d(first, x)) for x in sets], "lost": [np.setdiff1d(first, x).tobytes() for x in sets], "more": [np.setdiff1d(x, first).tobytes() for x in sets]})
    most, add = [0], jaccard.Tally.add

    def seen(self, cols):
        add(self, cols)
        most[0] = max(most[0], self.rows)

    monkeypatch.setattr(jaccard.Tally, "add", seen)
    jaccard._last_pairs(3)(lists, pa.concat_tables([table, answers]))
    far = [similarity(sets[i], sets[k]) for i in range(8, 248) for k in range(8, i)]
    assert sum(x < 0.75 for x in far) > 20_000 and max(x for x in far) < 0.75
    assert 0 < most[0] <= 2 * jaccard.PAIRS


def differences(leader, sets, own):
    """What ``_near_links`` is given of sets, each with its component, that one was compared with."""
    first, names = sets[leader], sorted(sets)
    n = [len(sets[s]) for s in names]
    lost, more = [np.setdiff1d(first, sets[s]).tobytes() for s in names], [np.setdiff1d(sets[s], first).tobytes() for s in names]
    return pa.table({"b": names, "root": [own[s] for s in names], "na": [len(first)] * len(names), "nb": n, "lost": pa.array(lost, pa.binary()), "more": pa.array(more, pa.binary())})


@pytest.mark.parametrize("seed", range(4))
def test_blocks_of_answers_find_what_links_connect(seed, monkeypatch):
    monkeypatch.setattr(jaccard, "SETTLED", 200)
    sets = {jaccard._name(x): x for x in made_sets(seed)}
    own = {s: s if k % 3 else min(sets) for k, s in enumerate(sorted(sets))}
    rows = differences(min(sets), sets, own)
    side = np.arange(len(rows)) % 2 == 0
    got = set()
    for before, after in ((side, ~side), (side, side), (~side, ~side)):
        held = rows.append_column("before", pa.array(before)).append_column("after", pa.array(after)).filter(pa.array(before | after))
        out = jaccard._near_links(held)
        got |= {tuple(sorted(p)) for p in zip(out.column("a").to_pylist(), out.column("b").to_pylist())}
    links = {(a, b) for b in sets for a in sets if a < b and own[a] != own[b] and similarity(sets[a], sets[b]) >= 0.75}
    assert got <= links
    joined = lambda pairs: {tuple(sorted((own[a], own[b]))) for a, b in pairs}
    assert links and joined(got) == joined(links)


@pytest.mark.parametrize("seed", range(6))
def test_lists_leave_to_blocks_only_what_one_first_set_answers(seed, monkeypatch):
    monkeypatch.setattr(jaccard, "HEAVY", 4)
    sets = {jaccard._name(x): x for x in made_sets(seed)}
    names, r, root = sorted(sets), random.Random(seed), {}
    for a in names:
        near = [b for b in names if b < a and b not in root and similarity(sets[a], sets[b]) >= 0.75]
        if near and r.random() < 0.8:
            root[a] = near[0]
    own = {a: root.get(a, a) for a in names}
    lists = pa.table({"part": [5], "blob": pa.array([entries(list(sets.values())).tobytes()], pa.binary())})
    there, times = np.unique(jaccard._lists(lists.column("blob").to_pylist())[0]["s"], return_counts=True)
    table = pa.table({"part": [5] * len(there), "s": there, "t": times, "root": [own[s] for s in there.tolist()]})
    asked = jaccard._asked(lists, table)
    pairs = list(zip(asked.column("a").to_pylist(), asked.column("b").to_pylist()))
    leaders = sorted({a for a, _ in pairs})
    large = set(leaders[1::2] or leaders)
    kept = lambda a, x: None if a in large else x.tobytes()
    answers = {"part": [5] * len(pairs), "s": [b for _, b in pairs], "t": [len(sets[a]) for a, _ in pairs], "root": [a for a, _ in pairs], "o": [len(np.intersect1d(sets[a], sets[b])) for a, b in pairs]}
    answers |= {"lost": pa.array([kept(a, np.setdiff1d(sets[a], sets[b])) for a, b in pairs], pa.binary()), "more": pa.array([kept(a, np.setdiff1d(sets[b], sets[a])) for a, b in pairs], pa.binary())}
    for name, kind in (("o", pa.int64()), ("lost", pa.binary()), ("more", pa.binary())):
        table = table.append_column(name, pa.nulls(len(there), kind))
    out = jaccard._last_pairs(3)(lists, pa.concat_tables([table, pa.table(answers)]))
    e = np.concatenate([np.frombuffer(x, jaccard.PAIR) for x in out.column("blob").to_pylist()] or [np.zeros(0, jaccard.PAIR)])
    by = {a: {b for x, b in pairs if x == a} for a in large}
    left = lambda p: any(p[0] in x and p[1] in x for x in by.values())
    links = {(a, b) for i, b in enumerate(names) for a in names[:i] if own[a] != own[b] and similarity(sets[a], sets[b]) >= 0.75}
    got = set(zip(e["a"].tolist(), e["b"].tolist()))
    root_of = lambda p: tuple(sorted((own[p[0]], own[p[1]])))
    assert {root_of(p) for p in links if not left(p)} <= {root_of(p) for p in got}
    assert not [p for p, c in zip(zip(e["a"].tolist(), e["b"].tolist()), e["c"].tolist()) if left(p) and c < jaccard.CERTAIN]


def test_many_near_copies_go_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MANY", 16)
    monkeypatch.setattr(jaccard, "SIDE", 24)
    seen, near = [], jaccard._near
    monkeypatch.setattr(jaccard, "_near", lambda *a: seen.append(near(*a)) or seen[-1])
    r = random.Random(11)
    base, rows = [f"w{i}" for i in range(120)], []
    for k in range(160):
        t = list(base) if k < 150 else [f"z{i}" for i in range(100)]
        for i in r.sample(range(len(t)), r.choice([1, 2, 3, 5, 6, 7])):
            t[i] = f"{r.choice('abc')}{r.randrange(9)}"
        rows.append((k, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((x.id, x.n_shingles, x.component_id) for x in jaccard.similar(df).collect())
    assert seen and got == brute(rows)
