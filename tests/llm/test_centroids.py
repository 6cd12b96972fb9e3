import hashlib

import duckdb
import numpy as np
import pytest

from isoptic.llm import centroids
from isoptic.llm.queries import SQL, op11_centroid_clustering


def plain(ids, vectors, k=8, rounds=10):
    """Clusters and centroids by full comparison, in Python's integers."""
    kept = [(i, [int(np.floor(float(x) * 1024)) for x in v]) for i, v in zip(ids, vectors, strict=True)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in order[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, one, strict=True)) for one in c]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = [nearest(v)[0] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, *nearest(v)) for i, v in kept], c


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string")


def run(spark, rows, **how):
    out = centroids.clusters(table(spark, rows), **how).collect()
    return sorted(((r.id is None, r.id, r.cluster, r.distance) for r in out), key=str), {r.cluster: list(r.centroid) for r in out}, out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_clusters_are_those_of_full_comparison(spark, seed):
    r = np.random.default_rng(seed)
    if seed == 2:  # few values: many ties, and centroids that coincide
        v = r.integers(0, 2, (60, 64)).astype(np.float32) * (r.random((60, 1)) < 0.3) / 1024
    else:
        v = (r.normal(size=(120, 64)) * 0.3 + r.normal(size=(5, 64))[r.integers(0, 5, 120)]).astype(np.float32)
    rows = [(int(i), [float(x) for x in one], "x") for i, one in enumerate(v)]
    got, centres, out = run(spark, rows)
    want, c = plain(range(len(v)), v)
    assert [g[1:] for g in got] == sorted(want, key=lambda x: str((False, *x)))
    for j, centre in centres.items():
        assert centre == c[j]
    for x in out:
        assert x.cluster_inertia == sum(d for _, o, d in want if o == x.cluster)
        assert x.inertia == sum(d for *_, d in want)


def test_unusable_vectors_are_left_out(spark):
    ok = [0.5] * 64
    rows = [(1, ok, "a"), (2, None, "a"), (3, [0.5] * 63, "a"), (4, [0.5] * 65, "a"), (5, [*ok[:63], None], "a"), (6, [*ok[:63], float("nan")], "a"), (7, [*ok[:63], float("inf")], "a"), (8, [*ok[:63], float("-inf")], "a"), (None, [0.25] * 64, "a"), (1, ok, "a")]
    got, _, _ = run(spark, rows)
    assert [g[1] for g in got] == [1, 1, None]
    assert centroids.clusters(table(spark, rows[1:8])).collect() == []
    assert centroids.clusters(table(spark, [])).collect() == []


def test_components_beyond_exact_distances_fail(spark):
    with pytest.raises(Exception, match="over 134217728"):
        centroids.clusters(table(spark, [(1, [3e38] * 64, "a")])).collect()


def test_floors_are_exact_for_negative_sums(spark):
    rows = [(i, [-(i + 1) / 1024] * 64, "a") for i in range(4)]
    got, centres, _ = run(spark, rows, k=1)
    assert centres == {0: [-3] * 64}  # -10 / 4
    assert [g[3] for g in got] == [4 * 64, 64, 0, 64]


def test_bounds_skip_most_vectors_and_change_nothing():
    r = np.random.default_rng(4)
    v = np.concatenate([r.integers(-3, 4, (300, 8)) + 100 * r.integers(-5, 6, (1, 8)) for _ in range(6)])
    old = v[[0, 300, 600, 900, 1200, 1500]].copy()
    own, upper, lower = centroids._scanned(v, old)
    skipped = 0
    for _ in range(6):
        new = np.array([v[own == j].sum(axis=0) // max(1, (own == j).sum()) if (own == j).any() else old[j] for j in range(6)])
        own, upper, lower, scanned = centroids.hamerly(v, own, upper, lower, old, new)
        d = centroids.squared(v, new)
        assert (own == d.argmin(axis=1)).all()
        exact = np.sqrt(d[np.arange(len(v)), own])
        assert (upper >= exact).all()
        d[np.arange(len(v)), own] = 1 << 60
        assert (lower <= np.sqrt(d.min(axis=1))).all()
        skipped += int((~scanned).sum())
        old = new
    assert skipped > 0.9 * 6 * len(v)


def test_the_query_is_its_sql(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    got = op11_centroid_clustering(spark, folder)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = db.sql(SQL["op11_centroid_clustering"])
    assert got.columns == want.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
