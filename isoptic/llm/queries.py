"""One query for each operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chosen_path, decontam, exact, jaccard, lines, mixing, pii, runs, substring, token_orc, toxicity, warc_zip
from .store import shared_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = toxicity.score(docs, toxicity.fit(docs, labels), name="score")
    held_out = toxicity.fold("doc_id") == toxicity.HELD_OUT
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.similar(_documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "class_id", "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixture(_documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "packages")
    warc_zip.write_packages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc_zip.read_packages(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.without_repeats(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.repeated_lines(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("line_text", 256).alias("kept_sha256"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_orc.write_tokens(_documents(spark, sf_dir), path, vocabulary())
    return token_orc.digests(spark, path)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact.exact_duplicates(_documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(_documents(spark, sf_dir))
    base = F.filter("spans", lambda x: x["k"] < pii.KINDS.index("term"))
    n = [pii.count(F.col("spans"), k).alias(f"n_{k}") for k in pii.KINDS[:4]]
    return out.select(F.col("id").alias("doc_id"), *n, F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroids.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",").cast("binary"), 256)
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op12_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chosen_path.similar(_documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.periodic_runs(runs.planted(_documents(spark, sf_dir)), "id")
    order = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    longest = out.withColumns({"n_runs": F.size("runs").cast("long"), "best": order, "listed": listed})
    length = -F.col("best.length")
    return longest.select(
        F.col("id").alias("doc_id"),
        "n_runs",
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_ngram_jaccard, op3_mixing, op4_warc, op5_decontamination, op6_substring, op7_line_dedup, op8_token_orc, op9_exact_dedup, op10_pii, op11_centroid_clustering, op12_chosen_path, op13_periodic_runs)}

ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _lloyd_sql(k: int = centroids.K, rounds: int = centroids.ROUNDS) -> str:
    """Full comparison of all vectors with all centroids, a round after the other."""
    near = "SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.row, z.c, list_sum(list_transform(list_zip(v.x, z.x), lambda p: ((p[1] - p[2]) * (p[1] - p[2]))::HUGEINT)) AS d FROM v, c{r} z) GROUP BY row"
    steps = [f"a{r} AS MATERIALIZED ({near.format(r=r)})" for r in range(rounds + 1)]
    moved = """s{n} AS (SELECT c, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT a.c, unnest(v.x) AS x, generate_subscripts(v.x, 1) AS i FROM a{r} a JOIN v ON v.row = a.row) GROUP BY c, i),
c{n} AS MATERIALIZED (SELECT z.c, coalesce(m.x, z.x) AS x FROM c{r} z LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{n} GROUP BY c) m ON m.c = z.c)"""
    chain = [part for r in range(rounds) for part in (steps[r], moved.format(r=r, n=r + 1))]
    return f"""
WITH u AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {centroids.SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.SIZE}),
v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(e, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS x FROM u),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, x) - 1 AS c, x FROM v QUALIFY c < {k}),
{", ".join(chain)}, {steps[rounds]}
SELECT v.vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(z.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v ON v.row = a.row JOIN c{rounds} z ON z.c = a.c"""


#: The CRC of a decimal number, bit by bit.
CRC32 = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
         lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, CASE WHEN y % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END)))"""


SQL = {
    "op2_ngram_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {ASCII}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS set FROM s GROUP BY doc_id),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY set) AS class_id FROM c)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.class_id, d.doc_id) AS class_id, min(r.y) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id JOIN r ON r.x = d.doc_id GROUP BY ALL""",
    "op3_mixing": """
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR || ':42'), 1, 13))::BIGINT AS o
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
             source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM src),
f AS (SELECT *, coalesce(sum(cap) OVER before, 0) AS filled, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open
      FROM w WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, weight * (budget - filled) >= cap * open AS fills FROM f),
h AS (SELECT *, sum(CASE WHEN fills THEN cap ELSE 0 END) OVER () AS capped, sum(CASE WHEN fills THEN 0 ELSE weight END) OVER () AS rest FROM g),
t AS (SELECT source, source_size, CASE WHEN fills THEN cap ELSE weight * (budget - capped) / rest END AS target FROM h),
p AS (SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
             coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY o, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN whole + CASE WHEN so_far + size / 2.0 < target - whole * source_size THEN 1 ELSE 0 END ELSE 0 END * size)::BIGINT AS taken
FROM p""",
    "op4_warc": """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
g AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND payload_bytes >= 1000""",
    "op6_substring": """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
h AS (SELECT doc_id, list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' '))) AS h FROM w),
x AS (SELECT doc_id, unnest(h) AS g, generate_subscripts(h, 1) AS pos FROM h),
f AS (SELECT g, min(doc_id) AS least FROM x GROUP BY g),
l AS (SELECT x.doc_id, x.pos FROM x JOIN f ON x.g = f.g AND f.least < x.doc_id),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
m AS (SELECT p.doc_id, p.pos, word, coalesce(max(CASE WHEN l.pos IS NOT NULL THEN 1 END) OVER (PARTITION BY p.doc_id ORDER BY p.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone
      FROM p LEFT JOIN l ON l.doc_id = p.doc_id AND l.pos = p.pos)
SELECT d.doc_id, count(word) AS n_words, coalesce(sum(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0), '')) AS kept_sha256
FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op7_line_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {SPACES}), {ASCII}) AS key FROM l),
d AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, d.last IS NOT NULL AND k.doc_id <> d.last AS gone FROM k LEFT JOIN d ON k.key = d.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op9_exact_dedup": f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), {ASCII}) AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.t) AS text_sha256 FROM t JOIN g ON t.t = g.t""",
    "op11_centroid_clustering": _lloyd_sql(),
    "op12_chosen_path": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {ASCII}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.y) AS component_id, d.doc_id = min(r.y) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.x = d.doc_id GROUP BY d.doc_id, n.n""",
    "op13_periodic_runs": f"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, xor(4294967295::BIGINT, {CRC32}) AS h FROM documents),
z AS (SELECT *, len(w)::BIGINT AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
p AS (SELECT doc_id, n, a, w, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - a) // (3 + g % 8) END AS p FROM z),
w AS MATERIALIZED (SELECT doc_id, n, CASE WHEN p IS NULL THEN w ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM p),
k AS MATERIALIZED (SELECT doc_id, unnest(range(0, n - 5)) AS i, unnest(list_transform(range(0, n - 5), lambda i: md5(array_to_string(w[i + 1:i + 6], ' ')))) AS k FROM w),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i < y.i),
b AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS b FROM m),
o AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 AS same FROM b GROUP BY doc_id, q, b),
r AS MATERIALIZED (SELECT doc_id, start, same + q AS length, min(q) AS period FROM o WHERE same + q >= greatest(12, 2 * q) GROUP BY doc_id, start, same + q),
s AS (SELECT doc_id, count(*) AS n_runs, arg_min((start, length, period), (-length, start, period)) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id),
f AS (SELECT doc_id, list_distinct(flatten(list(range(start + period, start + length)))) AS f FROM r GROUP BY doc_id),
c AS (SELECT w.doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM w),
d AS (SELECT doc_id, unnest(f) AS i FROM f),
t2 AS (SELECT c.doc_id, string_agg(word, ' ' ORDER BY c.i) AS kept FROM c ANTI JOIN d ON c.doc_id = d.doc_id AND c.i = d.i GROUP BY c.doc_id)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period, 1000 * best[2] // best[3] AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN s ON s.doc_id = w.doc_id LEFT JOIN t2 ON t2.doc_id = w.doc_id""",
}
