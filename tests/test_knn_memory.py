"""What a worker holds while blocks of queries meet blocks of the bank."""

import tracemalloc

import numpy as np
import pyarrow as pa

from engram.operators import knn


def pairs(n, queries, rows, dim=16):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(queries, dim)), rng.normal(size=(rows, dim))
    y[7] = y[3]
    x[1] = 0.0
    q_ids, ids = np.arange(queries, dtype="<i8"), np.arange(rows, dtype="<i8")
    row = {"q_ids": q_ids.tobytes(), "q_vectors": x.tobytes(), "ids": ids.tobytes(), "vectors": y.tobytes(), "dim": dim, "block": 0}
    return x, y, pa.RecordBatch.from_pylist([row] * n)


def test_a_pair_of_blocks_is_worked_on_in_slices():
    _, _, batch = pairs(4, knn.QUERIES, knn.ROWS)
    tracemalloc.start()
    found = sum(b.num_rows for b in knn._meeting(5)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 4 * 5 * knn.QUERIES
    assert peak < 4 * 8 * knn.AT_ONCE * knn.ROWS < 8 * knn.QUERIES * knn.ROWS  # one product of whole blocks is more


def test_slices_find_what_plain_sorting_finds():
    x, y, batch = pairs(1, knn.AT_ONCE + 3, 200)
    got = {}
    for b in knn._meeting(5)(iter([batch])):
        for r in b.to_pylist():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
    for i, q in enumerate(x):
        sim = np.array([(v @ q) / (np.linalg.norm(v) * np.linalg.norm(q)) if q.any() else 0.0 for v in y])
        assert got[i] == np.lexsort((np.arange(len(y)), -sim.round(12)))[:5].tolist()


def test_batches_of_blocks_are_small(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        knn.small_batches(spark)
        assert int(spark.conf.get(key)) == knn.SENT
        spark.conf.set(key, "1000")
        knn.small_batches(spark)
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, old)
