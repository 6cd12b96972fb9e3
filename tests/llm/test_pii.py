"""Personal data against a plain loop."""

import hashlib
import math
import re
import time
from collections import defaultdict

import regex

from pyspark.sql import functions as F

from isoptic.llm import pii
from isoptic.llm.queries import op10_pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def holds(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    return {"email": True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def brute(rows, alpha=pii.ALPHA, support=pii.SUPPORT):
    """Base spans, and terms that disclose, counted by document over whole texts, wherever they occur."""
    base, free, docs_of, df, both = {}, {}, defaultdict(set), defaultdict(set), defaultdict(set)
    for i, (_, text) in enumerate(rows):
        t = text or ""
        base[i] = [(k, m.start(), m.end(), m.group()) for k, p in PLAIN.items() for m in re.finditer(p, t) if holds(k, m.group())]
        words = [(m.start(), m.end(), m.group().lower()) for m in regex.finditer(r"\p{L}{4,}", t)]
        free[i] = [w for w in words if not any(x < w[1] and w[0] < y for _, x, y, _ in base[i])]
        for w in words:
            df[w[2]].add(i)
        for c in {(k, v.lower()) for k, _, _, v in base[i]}:
            docs_of[c].add(i)
            for w in {w[2] for w in free[i]}:
                both[c, w].add(i)
    n, out = len(rows), []
    risky = {w for (c, w), x in both.items() if len(x) >= support and len(docs_of[c]) < n and math.log2(n * len(x) / (len(docs_of[c]) * len(df[w]))) >= alpha * math.log2(n / len(docs_of[c]))}
    order = lambda x: (x[1], pii.KINDS.index(x[0]), x[2])
    line = lambda xs: ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(xs, key=order))
    for i, (d, _) in enumerate(rows):
        own = [x[:3] for x in base[i]]
        out.append((d, *[sum(x[0] == k for x in own) for k in PLAIN], hashlib.sha256(line(own).encode()).hexdigest(), line([*own, *[("term", a, b) for a, b, w in free[i] if w in risky]])))
    return out


CASES = [
    "x a@b.co y", "a@b.c+d@e.f", "é😀 mail a.b@c-d.e.f, 1.2.3.4.5.6.7.8 and 256.1.1.1 0255.1.1.01", "1" * 400 + ".1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111-1", "4111  1111 1111 1111 14111111111111111", "1 4111111111111111", "+1 (017) 555-7713 and +12--", "+1 234 567 89 0123456",
    "a" * 5000 + "@", "@@a@b.c@d.e", None, "", "4111111111111111\n5500005555555559-", "١٢٣ 4111111111111111",
    *["Kunde Wolfram schrieb an wolfram@web.example gestern abend"] * 3, *["andere Worte gestern abend hier"] * 20, *["Rufen +1 (017) 555-7713 Zebrafink an oder Zebrafink"] * 2,
]


def run(spark, rows, schema="doc_id long, text string, spans string"):
    df = spark.createDataFrame([(*r, "x") for r in rows], schema).repartition(3)
    out = pii.find(df)
    from pyspark.sql import functions as F

    base = F.filter("spans", lambda x: x["k"] < 4)
    n = [pii.count(F.col("spans"), k) for k in pii.KINDS[:4]]
    return [tuple(r) for r in out.select("id", *n, F.sha2(pii.written(base), 256), pii.written(F.col("spans"))).collect()]


def test_cases(spark):
    rows = list(enumerate(CASES))
    got, want = sorted(run(spark, rows)), sorted(brute(rows))
    for g, w in zip(got, want, strict=True):
        assert g == w, CASES[g[0]]
    assert any("term" in g[-1] for g in got)


def test_small_corpus(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = [tuple(r[c] for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")) for r in op10_pii(spark, folder).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_repeats_nulls_and_empty(spark):
    rows = [(1, "a@b.co"), (1, "a@b.co"), (None, "a@b.co"), (1, "other")]
    assert len(run(spark, rows)) == 4
    assert run(spark, []) == []


def test_sanitise(spark):
    df = spark.createDataFrame([(1, "to a@b.co now", 5), (2, None, 6)], "doc_id long, text string, base long")
    got = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert got[1].text == "to [EMAIL] now" and got[2].text is None and got[1].base == 5


FAR = ["Falkenrath schrieb " + "und so " * 30 + "an falke@web.example", "an falke@web.example " + "wie es " * 40 + "FALKENRATH 😀 Falkenrath", "ohne Adresse nur Falkenrath"]
EDGES = ["é1.2.3.4Zaunkönig x\0Zaunkönig\0 1.2.3.4é", "coétage@web.example a@b.coétage Zaunkönig 1.2.3.4", "étage +1 (017) 555-7713étage", "\0étage\0", ""]


def test_far_terms_and_other_documents(spark):
    rows = list(enumerate([*FAR, *EDGES, *CASES]))
    got = {r[0]: r for r in run(spark, rows)}
    assert sorted(got.values()) == sorted(brute(rows))
    assert got[0][-1].startswith("term:0:10,") and got[2][-1] == "term:17:27"
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, spans int, _i int, t int").repartition(3)
    clean = pii.sanitise(df)
    assert clean.columns == df.columns
    assert [r.text for r in clean.where("doc_id = 2").collect()] == ["ohne Adresse nur [TERM]"]


def test_a_text_of_very_many_matches(spark):
    """Places, what is hidden and what is replaced of 20,000 addresses and numbers in one text."""
    many = [f"user{i}@mail{i % 7}.example" if i % 3 else f"10.{i % 256}.0.{i % 300}" for i in range(20_000)]
    text = " and ".join(many)
    docs = spark.createDataFrame([(1, text), (2, "nothing here")], "doc_id long, text string")
    began = time.perf_counter()
    [spans] = [r.spans for r in pii.find(docs).collect() if r.id == 1]
    base = [(x.s, x.e) for x in spans if x.k < 4]
    at, want = 0, []
    for v in many:
        if "@" in v or int(v.rsplit(".", 1)[1]) <= 255:
            want.append((at, at + len(v)))
        at += len(v) + len(" and ")
    assert base == want
    [hidden] = docs.where("doc_id = 1").select(pii._hidden(F.col("text"), pii.base_spans(F.col("text"))).alias("h")).first()
    held = list(text)
    for s, e in want:
        held[s:e] = ["\0" if c.isalpha() and k in (0, e - s - 1) else " " for k, c in enumerate(text[s:e])]
    assert hidden == "".join(held)
    clean = [r.text for r in pii.sanitise(docs).collect() if r.doc_id == 1][0]
    assert clean == " and ".join("[EMAIL]" if "@" in v else "[IP]" if int(v.rsplit(".", 1)[1]) <= 255 else v for v in many)
    assert time.perf_counter() - began < 90
