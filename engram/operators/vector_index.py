"""A kept index for exact nearest neighbours by cosine, which meets only the blocks that can matter.

Vectors lie in blocks around pivots: each is dealt to the nearest of a sample of the unit vectors, and a block knows the middle and the radius of
its unit vectors. On the sphere, a block whose middle is d from a query and whose radius is r holds nothing nearer than d - r, so no
cosine above 1 - (d - r)^2 / 2. A search takes two passes: each query meets its nearest block, whose k-th best cosine is what others must reach; then it
meets the blocks whose bound reaches that, ties included. The result is exact whatever the data; how many blocks are spared
depends on them: of clustered vectors most, of vectors spread over a sphere of many dimensions none (``visits`` tells).

Rows of visits carry the queries' block, the block and which of the queries: queries and blocks meet by a join on the block's number.
An index is a table of blocks; blocks of further vectors are added to it, and an id stands in it once.

Null and odd input: null ids and null vectors are left out; vectors of different lengths never meet; a zero vector is similar to everything
by 0, zero vectors have blocks of their own; ties go to the smaller id; a bank smaller than k is returned whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.shared import written

#: Vectors of a block; queries of a block; blocks whose bounds are looked at together.
ROWS, QUERIES, BOUNDS = 4096, 1024, 4096
#: Pivots of one length, and numbers in all of them, at most: what each task is sent.
MOST_PIVOTS, MOST_NUMBERS = 4096, 1 << 21
#: How far bounds may err; similarities are of order 1.
SLACK = 1e-9
BLOCKS = "dim int, block long, n long, middle binary, radius double, ids binary, vectors binary"


def _usable(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    keyed = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return keyed.withColumn("dim", F.size("v"))


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    scaled = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])
    n = np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]
    return scaled / np.where(n > 0, n, 1.0)


def _pivots(rows: DataFrame, size: int) -> dict[int, np.ndarray]:
    """For each length the pivots: about as many as blocks, vectors with the least hashes of their ids; lengths of vectors are few."""
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    many = {d: max(1, min(MOST_PIVOTS, MOST_NUMBERS // max(1, d), -(-n // size))) for d, n in counts.items()}
    out = {}
    for d, n in many.items():
        some = rows.where(F.col("dim") == d).orderBy(F.xxhash64("id"), "id").limit(n).select("v").collect()
        out[d] = _units(np.array([r["v"] for r in some], dtype=np.float64).reshape(len(some), d))
    return out


def _dealt(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(id, v, dim, pivot); zero vectors have pivot -1."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)  # at most MOST_NUMBERS a length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, pivot = b.column(2).to_numpy(), np.zeros(b.num_rows, dtype=np.int32)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = _units(b.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d))
                pivot[at] = np.where(x.any(axis=1), (x @ sent.value[d].T).argmax(axis=1), -1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(pivot)], ["id", "v", "dim", "pivot"])

    return rows.mapInArrow(run, "id long, v array<double>, dim int, pivot int")


def _packed(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("id", kind="stable")
    x = np.array(frame["v"].tolist(), dtype=np.float64).reshape(len(frame), -1)
    unit = _units(x)
    middle = unit.mean(axis=0)
    radius = float(np.sqrt(((unit - middle) ** 2).sum(axis=1).max()))
    row = [frame["dim"].iloc[0], frame["block"].iloc[0], len(x), middle.tobytes(), radius, frame["id"].to_numpy("<i8").tobytes(), x.tobytes()]
    return pd.DataFrame([row], columns=["dim", "block", "n", "middle", "radius", "ids", "vectors"])


def _blocks(rows: DataFrame, size: int, first: int = 0) -> DataFrame:
    dealt = written(_dealt(rows, _pivots(rows, size)), "dealt")
    parts = dealt.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / size).alias("parts"))
    number = F.lit(first) + (F.col("pivot").cast("long") + 1) * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("parts"))
    return dealt.join(parts, ["dim", "pivot"]).select("dim", number.alias("block"), "id", "v").groupBy("dim", "block").applyInPandas(_packed, BLOCKS)


def build(bank: DataFrame, id_col: str = "vec_id", vector: str = "embedding", size: int = ROWS) -> DataFrame:
    """The blocks of a bank, as a written table: save it with any writer, read it back as an index."""
    return written(_blocks(written(_usable(bank, id_col, vector), "vectors"), size), "vector-index")


def extended(index: DataFrame, bank: DataFrame, id_col: str = "vec_id", vector: str = "embedding", size: int = ROWS) -> DataFrame:
    """The index with blocks of further vectors, whose ids are not in it; the old blocks are not touched."""
    last = index.agg(F.max("block")).first()[0]
    new = _blocks(written(_usable(bank, id_col, vector), "vectors"), size, 0 if last is None else (last | (1 << 46) - 1) + 1)
    return index.unionByName(written(new, "vector-index"))


def _bounds(index: DataFrame) -> DataFrame:
    """(dim, pack, blocks, middles, radii, packs): the small part of the blocks, some thousands together."""
    packs = index.groupBy("dim").agg(F.ceil(F.count("*") / BOUNDS).alias("packs"))
    dealt = index.select("dim", "block", "middle", "radius").join(packs, "dim").withColumn("pack", F.pmod(F.xxhash64("block"), F.col("packs")))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        row = [frame["dim"].iloc[0], frame["pack"].iloc[0], frame["packs"].iloc[0], frame["block"].to_numpy("<i8").tobytes(), b"".join(frame["middle"]), frame["radius"].to_numpy("<f8").tobytes()]
        return pd.DataFrame([row], columns=["dim", "pack", "packs", "blocks", "middles", "radii"])

    return dealt.groupBy("dim", "pack").applyInPandas(pack, "dim int, pack long, packs long, blocks binary, middles binary, radii binary")


_VISITS = "part long, dim int, block long, chosen binary"


def _bounding(batches: Iterator[pa.RecordBatch], reach: bool) -> Iterator[pa.RecordBatch]:
    """Visits of blocks of queries: the nearest block of each query, or all others that may hold what reaches its floor."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["q_ids"], "<i8")
            q = _units(np.frombuffer(row["q_vectors"], "<f8").reshape(len(ids), -1))
            blocks, radii = np.frombuffer(row["blocks"], "<i8"), np.frombuffer(row["radii"], "<f8")
            c = np.frombuffer(row["middles"], "<f8").reshape(len(blocks), -1)
            apart = np.sqrt(np.maximum(0.0, (q * q).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (q @ c.T)))
            zeros = ~c.any(axis=1) & (radii == 0)
            first = np.where(zeros[None, :], np.inf, apart).argmin(axis=1)
            met = np.zeros(apart.shape, dtype=bool)
            met[np.arange(len(q)), first] = True
            if reach:
                best = 1 - np.maximum(0.0, apart - radii[None, :] - SLACK) ** 2 / 2
                best[~q.any(axis=1)] = 0.0  # a zero query is similar to all by 0
                best[:, zeros] = 0.0  # and so are blocks of zero vectors to all
                floor = np.frombuffer(row["floor"], "<f8")
                met = (best >= floor[:, None] - SLACK) & ~met
            hit = np.flatnonzero(met.any(axis=0)).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * len(hit), pa.int64()), pa.array([row["dim"]] * len(hit), pa.int32()), pa.array([int(blocks[j]) for j in hit], pa.int64()),
                 pa.array([np.flatnonzero(met[:, j]).astype("<i4").tobytes() for j in hit], pa.binary())], ["part", "dim", "block", "chosen"],
            )


def _meeting(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of each block for each query that visits it."""
        for batch in batches:
            for row in batch.to_pylist():
                chosen, ids = np.frombuffer(row["chosen"], "<i4"), np.frombuffer(row["ids"], "<i8")
                qid = np.frombuffer(row["q_ids"], "<i8")
                x = np.frombuffer(row["q_vectors"], "<f8").reshape(len(qid), -1)[chosen]
                qid, y = qid[chosen], np.frombuffer(row["vectors"], "<f8").reshape(len(ids), -1)
                near = _units(x) @ _units(y).T
                least = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k] - SLACK if k < len(ids) else np.full(len(qid), -np.inf)
                xn, yn = (np.sqrt(np.einsum("ij,ij->i", z, z)) for z in (x, y))
                for i in range(len(qid)):
                    c = np.flatnonzero(near[i] >= least[i])
                    length = xn[i] * yn[c]
                    sim = np.where(length > 0, np.einsum("ij,j->i", y[c], x[i]) / np.where(length > 0, length, 1.0), 0.0)
                    top = np.lexsort((ids[c], -sim))[:k]
                    same = [np.full(len(top), v, dtype=t) for v, t in ((row["part"], np.int64), (row["dim"], np.int32), (chosen[i], np.int32), (qid[i], np.int64))]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*same, ids[c][top], sim[top])], ["part", "dim", "at", "query_id", "vec_id", "sim"])

    return run


_FOUND = "part long, dim int, at int, query_id long, vec_id long, sim double"


class Search:
    """One search of queries (query_id, embedding) in an index, pass by pass."""

    def __init__(self, queries: DataFrame, index: DataFrame, k: int, query_id: str = "query_id", vector: str = "embedding"):
        rows = written(_usable(queries, query_id, vector), "queries")
        parts = max(1, -(-rows.count() // QUERIES))

        def pack(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("id", kind="stable")
            row = [frame["part"].iloc[0], frame["dim"].iloc[0], frame["id"].to_numpy("<i8").tobytes(), np.array(frame["v"].tolist(), dtype=np.float64).tobytes()]
            return pd.DataFrame([row], columns=["part", "dim", "q_ids", "q_vectors"])

        packed = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).groupBy("part", "dim").applyInPandas(pack, "part long, dim int, q_ids binary, q_vectors binary")
        self.k, self.index, self.queries = k, index, written(packed, "packed-queries")
        self.bounds = written(_bounds(index), "bounds")
        # Each part of the queries meets each pack of bounds, by the pack's number.
        asked = self.queries.join(self.bounds.select("dim", "packs").distinct(), "dim").withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.col("packs") - 1))).drop("packs")
        self.looks = asked.join(self.bounds.drop("packs"), ["dim", "pack"])
        self.first = written(self.looks.mapInArrow(lambda b: _bounding(b, False), _VISITS), "visits")
        self.near = written(self._met(self.first), "near")
        ordered = W.partitionBy("part", "dim", "at").orderBy(F.desc("sim"))
        kth = self.near.withColumn("i", F.row_number().over(ordered)).where(F.col("i") == k).select("part", "dim", "at", "sim")
        floors = kth.groupBy("part", "dim").agg(F.map_from_entries(F.collect_list(F.struct("at", "sim"))).alias("kth"))  # QUERIES of a part at most
        self.rest = written(self._reaching(floors), "visits")

    def _met(self, visits: DataFrame) -> DataFrame:
        return visits.join(self.queries, ["part", "dim"]).join(self.index.select("dim", "block", "ids", "vectors"), ["dim", "block"]).mapInArrow(_meeting(self.k), _FOUND)

    def _reaching(self, floors: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.to_pylist()
                for row in rows:
                    floor = np.full(len(row["q_ids"]) // 8, -np.inf)
                    for at, sim in row.pop("kth") or []:
                        floor[at] = sim
                    row["floor"] = floor.tobytes()
                    yield from _bounding(iter([pa.RecordBatch.from_pylist([row])]), True)

        return self.looks.join(floors, ["part", "dim"], "left").mapInArrow(run, _VISITS)

    def visits(self) -> DataFrame:
        """(part, dim, block, queries): which blocks are met, by how many queries."""
        both = self.first.unionByName(self.rest)
        return both.groupBy("part", "dim", "block").agg(F.sum(F.length("chosen") / 4).cast("long").alias("queries"))

    def best(self) -> DataFrame:
        """(query_id, vec_id, sim, rank)"""
        found = self.near.unionByName(self._met(self.rest)).select("query_id", "vec_id", "sim")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= self.k)


def search(queries: DataFrame, index: DataFrame, k: int, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, sim, rank): for each query its k most similar vectors of the index."""
    return Search(queries, index, k, query_id, vector).best()
