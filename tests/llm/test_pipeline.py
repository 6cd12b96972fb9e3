"""The pipeline's stages against plain versions of each."""

import corpus_pipeline
import test_decontam
import test_formats
import test_jaccard

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    outs = []
    for _, f in corpus_pipeline.STAGES:
        at = f(spark, at, SF).cache()
        outs.append(at)
    clean, ones, held_clean, mix, tokens = outs
    for x in outs[:-1]:
        assert x.columns == docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    kept = {r.doc_id for r in clean.collect()}
    assert len(rows) - len(kept) <= len(toxic) + 4
    least = {c for _, _, c in test_jaccard.brute([(d, rows[d].text) for d in sorted(kept)])}
    assert {r.doc_id for r in ones.collect()} == least
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    # The plain alignment is slow: only with documents of a word run in common.
    grams = {tuple(w[i : i + 2]) for _, t in items for w in [test_decontam.words(t)] for i in range(len(w) - 1)}
    near = [(d, rows[d].text) for d in least if sum(tuple(w[i : i + 2]) in grams for w in [test_decontam.words(rows[d].text)[:4000]] for i in range(len(w) - 1)) > 6]
    kept = {r.doc_id for r in held_clean.collect()}
    gone = least - kept
    assert gone <= {d for d, _ in near}
    for d in gone:
        assert test_decontam.brute([(d, rows[d].text)], items)
    n = {d: len(test_jaccard.re.findall(r"[^\x20\x09-\x0D]+", rows[d].text or "")) for d in kept}
    taken = [r.doc_id for r in mix.collect()]
    assert max(map(taken.count, set(taken))) <= 2
    assert abs(sum(n[d] for d in taken) - 1.5 * sum(n.values())) < 0.15 * sum(n.values())
    assert sorted(tuple(r) for r in tokens.collect()) == test_formats.brute_tokens([(d, rows[d].text) for d in taken])


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def folder_of(spark, path, rows, labels, items):
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxicity double, _id int, id string, copies int"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    item = "one two three four five six seven eight nine ten"
    same = " ".join(f"a{i}" for i in range(40))
    texts = [(1, same), (2, same + " more"), (None, same), (3, None), (4, ""), (None, None), (5, "x " + item + " y"), (None, item), (6, "of its own"), (6, "another text of that id"), (7, "word " * 30_000)]
    rows = [(d, t, None, None if d == 6 else "s", None, 0.1, 1, "e", 9) for d, t in texts]
    folder_of(spark, f"file://{tmp_path}", rows, [(1, 0, 0), (None, None, 1), (4, 1, None)], [(1, item), (None, None), (2, "")])
    at = docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        at = f(spark, at, f"file://{tmp_path}").cache()
        assert at.columns == docs.columns
        if f is corpus_pipeline.without_leaks:
            left = sorted(f"{r.doc_id}:{str(r.text)[:12]}" for r in at.collect())
    assert left == sorted(["1:a0 a1 a2 a3 ", "3:None", "4:", "None:None", "6:of its own", "6:another text", "7:word word wo"])
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert out and sorted(r.start for r in out) == [sum(x.n_tokens for x in out if x.start < r.start) for r in sorted(out, key=lambda r: r.start)]


def test_empty_tables(spark, tmp_path):
    folder_of(spark, f"file://{tmp_path}", [], [], [])
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
