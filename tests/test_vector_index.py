import numpy as np
import pytest

from engram.operators import vector_index
from engram.operators.knn import knn

SCHEMA = "vec_id long, embedding array<double>"


def rows(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], SCHEMA).repartition(3)


def same(got, want):
    """Equal rows; similarities to the last digits that both ways of summing agree on."""
    a, b = ({(r["query_id"], r["rank"]): (r["vec_id"], r["sim"]) for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and a[k][1] == pytest.approx(b[k][1], abs=1e-12) for k in a)


def clustered(n, groups=12, dim=16, spread=0.05, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dim))
    return middles[np.arange(n) % groups] + spread * rng.normal(size=(n, dim))


@pytest.mark.parametrize("k", [1, 10])
def test_equals_the_search_of_all(spark, k):
    for x in (clustered(600), np.random.default_rng(2).normal(size=(500, 8))):
        bank = rows(spark, x)
        queries = bank.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
        same(vector_index.search(queries, vector_index.build(bank, size=64), k), knn(queries, bank, k))


def test_far_blocks_are_not_met(spark):
    bank = rows(spark, clustered(1200))
    queries = bank.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    index = vector_index.build(bank, size=50).cache()
    found = vector_index.Search(queries, index, 5)
    met, blocks = sum(r["queries"] for r in found.visits().collect()), index.count()
    assert blocks >= 20 and met < 12 * blocks / 3
    same(found.best(), knn(queries, bank, 5))


def test_ties_zeros_lengths_nulls_and_repeats(spark):
    x = [[1.0, 0.0], [2.0, 0.0], [0.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [3.0, 0.0], [0.0, -0.0], [5e200, 0.0]]
    made = [(i, v) for i, v in enumerate(x)] + [(20, [1.0, 0.0, 0.0]), (21, [0.0] * 3), (22, None), (None, [1.0, 1.0])] + [(i, [1.0, 0.0]) for i in range(30, 60)]
    bank = spark.createDataFrame(made[:7] + made[8:], SCHEMA)
    queries = bank.where("vec_id < 22").withColumnRenamed("vec_id", "query_id")
    for size in (2, 1000):
        same(vector_index.search(queries, vector_index.build(bank, size=size), 4), knn(queries, bank, 4))


def test_extended_saved_and_read_again(spark, tmp_path):
    x = clustered(500, seed=3)
    bank = rows(spark, x)
    queries = bank.where("vec_id % 25 = 0").withColumnRenamed("vec_id", "query_id")
    index = vector_index.build(bank.where("vec_id < 200"), size=40)
    for lo, hi in ((200, 350), (350, 500)):
        old = {(r["dim"], r["block"], bytes(r["ids"])) for r in index.collect()}
        index = vector_index.extended(index, bank.where(f"vec_id >= {lo} AND vec_id < {hi}"), size=40)
        now = {(r["dim"], r["block"], bytes(r["ids"])) for r in index.collect()}
        assert old < now and len({(d, b) for d, b, _ in now}) == len(now)
    index.write.parquet(str(tmp_path / "index"))
    same(vector_index.search(queries, spark.read.parquet(str(tmp_path / "index")), 7), knn(queries, bank, 7))


def test_nothing_to_search(spark):
    none, bank = spark.createDataFrame([], SCHEMA), rows(spark, clustered(30))
    queries = bank.withColumnRenamed("vec_id", "query_id")
    assert vector_index.search(queries, vector_index.build(none), 3).count() == 0
    assert vector_index.search(queries.where("false"), vector_index.build(bank), 3).count() == 0
    assert vector_index.extended(vector_index.build(none), bank).count() == 1
