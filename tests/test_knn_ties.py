"""Ties at the cut of the k nearest: all of them are ordered by id, however many there are."""

import numpy as np
import pytest

from engram.operators import knn as K

D = 4


def brute(queries, bank, k):
    out = set()
    for q, x in queries:
        ranked = []
        for i, y in bank:
            length = np.sqrt(np.dot(x, x)) * np.sqrt(np.dot(y, y))
            ranked.append((-round(float(np.dot(x, y) / length), 9) if length else 0.0, i))
        out |= {(q, i, r) for r, (_, i) in enumerate(sorted(ranked)[:k], 1)}
    return out


def found(spark, queries, bank, k):
    q = spark.createDataFrame([(i, x.tolist()) for i, x in queries], "query_id long, embedding array<double>")
    b = spark.createDataFrame([(i, x.tolist()) for i, x in bank], "vec_id long, embedding array<double>").repartition(3)
    return {(r["query_id"], r["vec_id"], r["rank"]) for r in K.knn(q, b, k).collect()}


@pytest.mark.parametrize("kind", ["equal", "proportional"])
def test_many_rows_tie_at_the_cut(spark, kind):
    rng = np.random.default_rng(1)
    line = np.array([1.0, 2.0, -1.0, 0.0])
    # Powers of two: the similarities of proportional vectors are equal to the last bit.
    tied = [(i, line * (2.0 ** (i % 9) if kind == "proportional" else 1.0)) for i in range(400)]
    bank = tied + [(i, rng.normal(size=D)) for i in range(400, 3000)]
    queries = [(0, line), (7, line * 2), (500, bank[500][1])]
    assert found(spark, queries, bank, 10) == brute(queries, bank, 10)


def test_zero_query_and_zero_rows(spark):
    rng = np.random.default_rng(2)
    bank = [(i, rng.normal(size=D)) for i in range(2000)] + [(i, np.zeros(D)) for i in range(2000, 2300)]
    queries = [(9, np.zeros(D)), (10, bank[10][1])]
    assert found(spark, queries, bank, 10) == brute(queries, bank, 10)
    assert {(9, i, i + 1) for i in range(10)} <= found(spark, queries, bank, 10)


def test_fewer_copies_than_the_bank_needs(spark):
    bank = [(i, np.ones(D)) for i in range(50)] + [(i, -np.ones(D)) for i in range(50, 60)]
    queries = [(55, -np.ones(D))]
    assert found(spark, queries, bank, 12) == brute(queries, bank, 12)
