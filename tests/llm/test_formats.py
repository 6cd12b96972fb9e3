"""Round trips of the two file formats."""

import hashlib
import io
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoptic.llm import token_orc, warc_zip
from isoptic.llm.queries import vocabulary
from isoptic.llm.store import shared_path

TEXTS = [
    (5, "Thntblere of then, it's <|endoftext|> É́  x"),
    (3, None),
    (3, None),
    (2, ""),
    (None, "a b"),
    (9, "word " * 3000),
    (11, "x" * 20_000),
    (12, "a\x01b \x01 c\x01. <|ENDOFTEXT|> x<|endoftext|>. dogs'. 'stop IT'S, É!, …, 3.14. a..b?! ?! . <b.>."),
    (13, "\u0301a, \u00a0b. c\u0085d, ½. Σ. ΑΣ,"),
    (8, "\x0b tab\tnl\n 123 don't"),
    (8, "\x0b tab\tnl\n 123 don't"),
]


def brute_tokens(rows, file=None):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file or vocabulary())
    out, at = [], 0
    for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_tokens_round_trip(spark):
    docs = spark.createDataFrame([(*r, "clash") for r in TEXTS], "doc_id long, text string, ids string").repartition(3)
    path = shared_path(spark, "t")
    token_orc.write_tokens(docs, path, vocabulary())
    got = [tuple(r) for r in token_orc.digests(spark, path).collect()]
    key = lambda r: (r[1], r[2])
    assert sorted(got, key=key) == brute_tokens(TEXTS)
    one = token_orc.read_tokens(spark, path, [9]).collect()
    assert [r.doc_id for r in one] == [9] and len(one[0].ids) == one[0].n_tokens


def test_tokens_of_the_small_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = shared_path(spark, "t")
    token_orc.write_tokens(docs, path, vocabulary())
    got = sorted(tuple(r) for r in token_orc.digests(spark, path).collect())
    assert got == brute_tokens([(r.doc_id, r.text) for r in docs.collect()])


def test_a_tokenizer_of_other_rules(spark, tmp_path):
    """A file that doesn't cut texts at words has whole texts encoded."""
    import json

    with open(vocabulary(), encoding="utf-8") as f:
        rules = json.load(f)
    assert token_orc.splits_at_words(rules)
    rules["normalizer"]["normalizers"] = [{"type": "Lowercase"}]
    rules["pre_tokenizer"]["pretokenizers"] = rules["pre_tokenizer"]["pretokenizers"][1:]
    assert not token_orc.splits_at_words(rules)
    other = tmp_path / "other.json"
    other.write_text(json.dumps(rules), encoding="utf-8")
    path = shared_path(spark, "t")
    token_orc.write_tokens(spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3), path, str(other))
    got = [tuple(r) for r in token_orc.digests(spark, path).collect()]
    key = lambda r: (r[1], r[2])
    assert sorted(got, key=key) == brute_tokens(TEXTS, str(other))


def test_no_tokens(spark):
    path = shared_path(spark, "t")
    token_orc.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, vocabulary())
    assert token_orc.digests(spark, path).count() == 0


def test_packages_round_trip(spark):
    big, other = "p" * 1000, "é" * 700
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "http://c", big + "q"), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "http://é", other), (9, "u", other), (None, "u", big), (2, "u", big)]
    path = shared_path(spark, "p")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("x", "y").repartition(3)
    assert warc_zip.write_packages(pages, path) == len(rows)
    got = warc_zip.read_packages(spark, path).collect()
    last = {big: 2, other: 9}
    want = []
    for p, _, h in rows:
        raw, to = (h or "").encode(), last.get(h)
        again = to is not None and to != p
        want.append((str(p), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", str(to if again else None), None if again else raw))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to), None if r.payload is None else bytes(r.payload)) for r in got) == sorted(want, key=lambda x: x[:5])


def test_records_are_read_by_many_tasks(spark, monkeypatch):
    """One package, adaptive execution on: its records aren't packed into one task."""
    monkeypatch.setattr(warc_zip, "TASK_BYTES", 20_000)
    monkeypatch.setattr(warc_zip, "CHUNK_BYTES", 10_000)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    r = np.random.default_rng(0)
    pages = spark.createDataFrame([(i, "u", r.bytes(1500).hex()) for i in range(300)], "page_id long, url string, html string").coalesce(1)
    path = shared_path(spark, "p")
    assert warc_zip.write_packages(pages, path) == 300
    got = warc_zip.read_packages(spark, path).withColumn("task", F.spark_partition_id())
    assert got.select("page_id").distinct().count() == 300 and got.select("task").distinct().count() > 4


def test_no_packages(spark):
    path = shared_path(spark, "p")
    assert warc_zip.write_packages(spark.createDataFrame([], "page_id long, url string, html string"), path) == 0
    assert warc_zip.read_packages(spark, path).count() == 0


def test_directory_of_a_plain_zip():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.comment = b"PK\x05\x06 in the comment"
        z.writestr("archive/a.warc.gz", b"stored")
        z.writestr(zipfile.ZipInfo("b"), b"deflated", zipfile.ZIP_DEFLATED)
    data = raw.getvalue()
    found = warc_zip.members(lambda at, n: data[at : at + n], len(data))
    assert {k: data[a : a + n] for k, (a, n) in found.items()} == {"archive/a.warc.gz": b"stored"}


def test_zip64_end(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for i in range(6):
            z.writestr(f"m{i}", b"x" * (20 + i))
    data = raw.getvalue()
    assert b"PK\x06\x06" in data
    found = warc_zip.members(lambda at, n: data[at : at + n], len(data))
    assert [data[a : a + n] for a, n in found.values()] == [b"x" * (20 + i) for i in range(6)]
    with pytest.raises(ValueError):
        warc_zip.members(lambda at, n: data[at : at + n][:-9], 40)
