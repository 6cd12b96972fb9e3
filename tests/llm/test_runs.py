import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoptic.llm import runs, tokens
from isoptic.llm.queries import op13_periodic_runs

WORDS = runs.WORD


def plain(words, least=12):
    """(start, length, period) of all runs, by the definition."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n_, q) for (s, n_), q in best.items())


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def samples():
    r = random.Random(5)
    out = [None, "", " \n\t ", "a", "a " * 11, "a " * 12, "a b " * 6, "a b " * 5 + "a", "x " * 500, ("p q r s t u v " * 2).strip(), "p q r s t u v p q r s t u", "a\x0bb\x0ca\rb a\tb\na b a b a b"]
    for _ in range(60):
        words = [r.choice("ab" if r.random() < 0.5 else "abcdefgh") for _ in range(r.randrange(1, 120))]
        if r.random() < 0.7:
            at, p = r.randrange(len(words)), r.randrange(1, 15)
            part = words[at : at + p]
            words[at : at + p] = part * r.randrange(2, 9)
        out.append((" " if r.random() < 0.5 else "\n ").join(words))
    # Fibonacci words have runs within runs.
    a, b = ["a"], ["a", "b"]
    for _ in range(10):
        a, b = b, b + a
    return [*out, " ".join(b), "é ü 漢字 " * 9, "one two three " + "y z " * 40 + "four " + "y z " * 40]


@pytest.mark.parametrize("least", [2, 5, 12, 16, 17, 33])
def test_the_search_finds_what_the_definition_says(least):
    r = np.random.default_rng(least)
    for _ in range(40):
        parts = [np.tile(r.integers(0, r.integers(1, 5), r.integers(1, 20)), r.integers(1, 9)) for _ in range(r.integers(1, 6))]
        first = np.append(0, np.cumsum([len(p) for p in parts]))
        start, length, period = runs.main_lorentz(np.concatenate(parts), first, least)
        want = [(int(b) + s, n, q) for b, p in zip(first, parts, strict=False) for s, n, q in plain(p.tolist(), least)]
        assert sorted(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == sorted(want)


def test_masked_words_are_in_no_run():
    import pyarrow as pa

    texts = samples()
    w = tokens.words(pa.array(texts))
    kept = runs.repeated(w, runs.overlap())
    for row, text in enumerate(texts):
        inside = {i for s, n, _ in plain(split(text)) for i in range(s, s + n)}
        assert inside <= set(np.flatnonzero(kept[w.first[row] : w.first[row + 1]]).tolist())
    ordinary = tokens.words(pa.array([" ".join(str(i % 997) for i in range(900))]))
    assert not runs.repeated(ordinary, 6).any()


def test_runs_and_collapsed_texts_are_those_of_the_definition(spark):
    texts = samples()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, runs string, collapsed int")
    got = {r.id: r for r in runs.periodic_runs(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words = split(text)
        want = plain(words)
        assert [tuple(x) for x in got[i].runs] == want, i
        assert got[i].n_words == len(words)
        assert got[i].collapsed == collapsed(words, want)


def test_ids_can_be_null_or_repeat_and_tables_be_empty(spark):
    docs = spark.createDataFrame([(None, "a " * 12), (1, "a " * 12), (1, "b")], "doc_id long, text string")
    assert sorted((r.id or 0, len(r.runs)) for r in runs.periodic_runs(docs).collect()) == [(0, 1), (1, 0), (1, 1)]
    assert runs.periodic_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError, match="two words"):
        runs.periodic_runs(docs, least=1)


def test_a_very_long_text_ends(spark):
    r = random.Random(1)
    text = " ".join(r.choice("abcdefghij") + str(r.randrange(300)) for _ in range(150_000)) + " z" * 150_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    [row] = runs.periodic_runs(docs).collect()
    assert [tuple(x) for x in row.runs] == [(150_000, 150_000, 1)]
    assert row.n_words == 300_000 and row.collapsed == text[: len(text) - 2 * 149_999]


def test_the_query_is_the_brute_force_result(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10_001, None), (10_002, ""), (10_010, "w " * 50), (None, "v " * 20)], "doc_id long, text string")
    source.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op13_periodic_runs(spark, str(tmp_path)).collect()}
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    assert len(got) == len(rows)
    for row in rows:
        words = split(row.text)
        if row.doc_id is not None and words and (h := zlib.crc32(str(row.doc_id).encode())) % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = plain(words)
        longest = min(((-n, s, q) for s, n, q in found), default=None)
        x = got[row.doc_id]
        assert x.n_runs == len(found)
        want = (None,) * 4 if longest is None else (longest[1], -longest[0], longest[2], 1000 * -longest[0] // longest[2])
        assert (x.start, x["length"], x.period, x.exponent_milli) == want
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(collapsed(words, found).encode()).hexdigest()


def test_planted_texts_keep_their_words_up_to_a_place(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("a b c d e f g h i j k l m n o p q r s t").alias("text"))
    changed = [r for r in runs.planted(docs).collect() if r.text != "a b c d e f g h i j k l m n o p q r s t"]
    assert changed and all(zlib.crc32(str(r.id).encode()) % 10 == 0 for r in changed)
