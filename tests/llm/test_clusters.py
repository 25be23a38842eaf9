import hashlib
import random

import duckdb
import numpy as np
import pytest

from engram.llm import clusters


def brute(rows, k, rounds):
    """Plain Lloyd in Python's integers."""
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) and abs(x) < 2**53 for x in v)]
    known = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None) + sorted(("~", v) for i, v in kept if i is None)
    centroids = [v for _, v in known[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {j: sum(d for _, c, d in found if c == j) for j in range(len(centroids))}
    return [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, j, d in found]


def vectors(seed, n, spread=0.05):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, 64))
    rows = [(i, (middles[i % 5] + spread * rng.normal(size=64)).astype(np.float32).astype(float).tolist()) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(min(n, 20))]  # copies
    rows += [(n + 30 + i, [float(i % 2)] * 64) for i in range(12)]  # ties
    return rows


def odd(rows):
    bad = [(900, None), (901, [1.0] * 63), (902, [None] + [1.0] * 63), (903, [float("nan")] * 64), (904, [float("inf")] * 64), (905, []), (906, [1e30] * 64)]
    return [*rows, *bad, (None, rows[0][1]), (3, rows[3][1]), (3, rows[4][1]), (907, [0.0] * 64)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance string").repartition(3)


@pytest.mark.parametrize(("seed", "n", "k", "rounds"), [(1, 150, 8, 10), (2, 80, 3, 4), (3, 4, 40, 2), (4, 60, 1, 2)])
def test_equals_plain_lloyd(spark, seed, n, k, rounds):
    rows = odd(vectors(seed, n, 0.05 if seed % 2 else 1.0))
    got = [tuple(r) for r in clusters.clustered(table(spark, rows), k, rounds).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, k, rounds), key=repr)


def test_large_components_are_exact(spark):
    rows = vectors(5, 40) + [(700 + i, [100_000.25 * (-1) ** i] * 64) for i in range(5)] + [(800, [4e9] * 64)]
    got = {r[0]: tuple(r) for r in clusters.clustered(table(spark, rows), 3, 3).collect()}
    want = {r[0]: r for r in brute(rows, 3, 3)}
    fits = lambda x: x if x < 1 << 63 else None
    assert got == {i: (i, r[1], fits(r[2]), fits(r[3]), fits(r[4]), r[5]) for i, r in want.items()}


def test_bounds_spare_distances():
    rng = np.random.default_rng(6)
    middles = rng.integers(-5000, 5000, size=(40, 64))
    x = (middles[rng.integers(0, 40, 4000)] + rng.integers(-200, 200, size=(4000, 64))).astype(np.float64)
    m = clusters.Model([list(map(int, r)) for r in x[:40]])
    cluster, upper, lower = np.zeros(len(x), dtype=np.int32), np.full(len(x), np.inf), np.zeros(len(x))
    spent = []
    for _ in range(6):
        if m.moved is not None:
            upper, lower = clusters.drifted(m, cluster, upper, lower)
        cluster, upper, lower, done = clusters.exponion(m, x, cluster, upper, lower)
        spent.append(done)
        d = clusters.squared(x, m.doubles)
        assert (cluster == d.argmin(axis=1)).all() and (upper >= np.sqrt(d.min(axis=1))).all()
        m = m.next({j: (int((cluster == j).sum()), [int(v) for v in x[cluster == j].sum(axis=0)]) for j in set(cluster.tolist())})
    assert spent[0] > 4000 * 39 and spent[-1] < 4000 * 10


def test_ties_go_to_the_smaller_number():
    m = clusters.Model([[2] * 64, [0] * 64, [0] * 64])
    x = np.array([[1.0] * 64, [0.0] * 64])
    for start in (0, 1, 2):
        cluster, *_ = clusters.exponion(m, x, np.full(2, start, dtype=np.int32), np.full(2, np.inf), np.zeros(2))
        assert cluster.tolist() == [0, 1]


def test_sql_and_empty(spark, tmp_path):
    rows = vectors(7, 60)
    table(spark, rows).select("vec_id", "embedding").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = [tuple(r) for r in clusters.op13_centroids(spark, str(tmp_path)).collect()]
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want = con.sql(f"SELECT {', '.join(names)} FROM ({clusters.OP13_SQL})").fetchall()
    assert sorted(got) == sorted(want)
    assert clusters.clustered(table(spark, [])).collect() == []
