"""Exact nearest neighbours by cosine, query blocks against blocks of the bank.

Neither side is broadcast: queries and bank rows are packed into blocks, each query block meets each bank block once, and a
block pair gives its best k rows of each query. A matrix product finds all rows that may be among them: those at or above the
k-th best product less a margin for rounding, however many tie there. Their similarity is then computed row by row in
double precision, so it does not depend on the blocking, and ties are ordered by id. Of equal vectors in a block only the k
smallest ids are kept, as no other can be among the best k. A window merges the blocks' best.

A worker holds a few block pairs at a time, read where Arrow has them, and the products of AT_ONCE queries with a bank block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERIES, ROWS = 1024, 8192
#: Queries of a block whose products are in work at once; bytes of block pairs that a worker is sent at once.
AT_ONCE, SENT = 128, 8 << 20
_PACKED = "block long, ids binary, vectors binary, dim int"


def _packed(rows: DataFrame, id_col: str, vector: str, size: int, copies: int | None = None) -> DataFrame:
    """Rows in blocks of about ``size`` vectors, each of one length, ids as long; of equal vectors in a block the ``copies`` smallest
    ids, or all."""
    n = rows.count()
    blocks = max(1, -(-n // size))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        x = np.array(frame["v"].tolist(), dtype=np.float64)
        if copies is not None:
            first = (pd.Series(0, index=[v.tobytes() for v in x]).groupby(level=0).cumcount() < copies).to_numpy()
            frame, x = frame[first], x[first]
        return pd.DataFrame({"block": [int(frame["block"].iloc[0])], "ids": [frame["id"].to_numpy("<i8").tobytes()], "vectors": [x.tobytes()], "dim": [x.shape[1]]})

    keyed = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return keyed.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("block", F.size("v").alias("dim")).applyInPandas(pack, _PACKED)


def small_batches(spark: SparkSession) -> None:
    """What Python gets comes in batches of SENT bytes or little more: rows that hold whole blocks would add up otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", spark.conf.get(key).strip().lower()).groups()
    if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= SENT:
        spark.conf.set(key, str(SENT))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
    """Row by row; binary values are views of the batch and not copied."""
    for batch in batches:
        for i in range(batch.num_rows):
            values = {name: batch.column(name)[i] for name in batch.schema.names}
            yield {name: v.as_buffer() if isinstance(v, pa.BinaryScalar) else v.as_py() for name, v in values.items()}


def _meeting(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of each bank block for each query that meets it."""
        for row in rows_of(batches):
            all_ids, ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
            all_x = np.frombuffer(row["q_vectors"], "<f8").reshape(len(all_ids), -1)
            y = np.frombuffer(row["vectors"], "<f8").reshape(len(ids), -1)
            yn = np.sqrt(np.einsum("ij,ij->i", y, y))
            for low in range(0, len(all_ids), AT_ONCE):
                qid, x = all_ids[low : low + AT_ONCE], all_x[low : low + AT_ONCE]
                xn = np.sqrt(np.einsum("ij,ij->i", x, x))
                near = x @ y.T
                near /= np.where(yn > 0, yn, 1.0)
                near[~(xn > 0)] = 0.0
                near[:, ~(yn > 0)] = 0.0
                least = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k] if k < len(ids) else np.full(len(qid), -np.inf)
                least -= 4 * (x.shape[1] + 4) * np.finfo(np.float64).eps * xn  # above what both ways of summing can differ by
                tops, sims = [], []
                for i in range(len(qid)):
                    c = np.flatnonzero(~(near[i] < least[i]))
                    length = xn[i] * yn[c]
                    sim = np.where(length > 0, np.einsum("ij,j->i", y[c], x[i]) / np.where(length > 0, length, 1.0), 0.0)
                    top = np.lexsort((ids[c], -sim))[:k]
                    tops.append(ids[c][top])
                    sims.append(sim[top])
                found = np.repeat(qid, [len(t) for t in tops])
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.concatenate(tops)), pa.array(np.concatenate(sims))], ["query_id", "vec_id", "sim"])

    return run


def knn(queries: DataFrame, bank: DataFrame, k: int, query_id: str = "query_id", bank_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, sim, rank): for each query its k most similar rows of the bank, ties to the smaller id. A zero vector is
    similar to everything by 0; a bank smaller than k is returned whole."""
    small_batches(bank.sparkSession)
    q = _packed(queries, query_id, vector, QUERIES).select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    b = _packed(bank, bank_id, vector, ROWS, k)
    keys = b.select("dim", "block")
    visits = q.join(keys, "dim").join(b, ["dim", "block"])
    found = visits.mapInArrow(_meeting(k), "query_id long, vec_id long, sim double")
    order = W.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
