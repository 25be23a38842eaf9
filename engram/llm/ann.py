"""Approximate nearest neighbours on robust-pruned directed graphs.

Equal vectors are one node that keeps the smallest ids of its members. Nodes are dealt to shards of about SHARD by a hash, and by how large their components are. In
a shard, points are inserted in batches: a greedy beam search from the medoid over the graph so far proposes neighbours, and
robust pruning keeps up to DEGREE of them: the nearest candidate stays and removes those that it is nearer to by the factor
ALPHA, again and again; back edges are added and pruned alike. Every row is indexed. Queries are packed into blocks; each
block meets each shard once, a beam search per query finds its nodes, which are ranked by the exact distance in double
precision; the shards' best are merged per query.

Null and odd input: vectors that are null, empty, zero or hold a null or non-finite component take no part; vectors of
different lengths never meet; ties go to the smaller id; rows repeated with one id count once, with the least of their
vectors; fewer than K candidates are all returned; an empty table gives an empty result. Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.llm.common import integer_ids, written

K, SHARD, DEGREE, BEAM, ALPHA = 10, 4096, 32, 64, 1.2
#: Nodes kept by a search of a query; vectors of a block of queries; nodes expanded at once.
SEARCH, BLOCK, WIDTH, SEED = 96, 1024, 4, 7
#: Vectors whose largest components are within this many powers of two share shards; powers of two by which a query may
#: exceed a shard in single precision, and in double precision.
MAGNITUDE, NEAR, FAR = 16, 40, 400


def _squares(x: np.ndarray, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of each q to its own rows of x."""
    d = x[rows] - q[:, None, :]
    return np.einsum("brd,brd->br", d, d)


def beam_search(x: np.ndarray, graph: np.ndarray, start: np.ndarray, q: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each q the nodes of its final beam and their squared distances, nearest first, and a mask of all nodes met.

    graph: the neighbours of each node, padded with -1. A round expands the WIDTH nearest nodes not expanded yet."""
    n, b = len(x), len(q)
    beam = min(max(beam, len(start)), n)
    met = np.zeros((b, n + 1), dtype=bool)
    met[:, n] = True  # stands for the padding
    ids = np.full((b, beam), n)
    dist = np.full((b, beam), np.inf, dtype=x.dtype)
    first = start
    ids[:, : len(first)], dist[:, : len(first)] = first, _squares(x, np.broadcast_to(first, (b, len(first))), q)
    met[:, first] = True
    done = np.zeros((b, beam), dtype=bool)
    rows = np.arange(b)[:, None]
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = ids[rows, order], dist[rows, order]
    while True:
        open_ = ~done & (ids < n)
        if not open_.any():
            return ids, dist, met[:, :n]
        rank = np.cumsum(open_, axis=1)
        take = open_ & (rank <= WIDTH)
        done |= take
        at = np.argsort(~take, axis=1, kind="stable")[:, :WIDTH]
        chosen = np.where(take[rows, at], ids[rows, at], n)
        near = np.where(chosen[:, :, None] < n, graph[np.minimum(chosen, n - 1)], -1).reshape(b, -1)
        near = np.where(near < 0, n, near)
        near.sort(axis=1)
        again = np.zeros_like(near, dtype=bool)
        again[:, 1:] = near[:, 1:] == near[:, :-1]
        fresh = ~again & ~met[rows, near]
        met[rows, near] = True
        d = np.full(near.shape, np.inf, dtype=x.dtype)
        r, c = np.nonzero(fresh)
        diff = x[near[r, c]] - q[r]
        d[r, c] = np.einsum("ij,ij->i", diff, diff)
        ids, dist = np.concatenate([ids, np.where(fresh, near, n)], axis=1), np.concatenate([dist, d], axis=1)
        done = np.concatenate([done, np.zeros_like(fresh)], axis=1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        ids, dist, done = ids[rows, order], dist[rows, order], done[rows, order]


def prune(x: np.ndarray, p: int, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning: up to ``degree`` candidates that no kept one covers."""
    c = candidates[candidates != p]
    d = x[c] - x[p]
    d = np.einsum("ij,ij->i", d, d)
    order = np.lexsort((c, d))
    c, d = c[order], d[order]
    y = x[c]
    norm = np.einsum("ij,ij->i", y, y)
    between = norm[:, None] + norm[None, :] - 2 * (y @ y.T)
    left, kept = np.ones(len(c), dtype=bool), []
    for k in range(len(c)):
        if left[k]:
            kept.append(c[k])
            if len(kept) == degree:
                break
            left &= alpha * alpha * between[k] > d
    return np.array(kept, dtype=np.int64)


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(graph, start nodes) over the rows of x."""
    n = len(x)
    rng = np.random.default_rng(SEED)
    slack = DEGREE + DEGREE // 2  # back edges beyond DEGREE wait for a pruning at this many
    graph = np.full((n, slack), -1, dtype=np.int64)
    used = np.zeros(n, dtype=np.int64)
    middle = x.mean(axis=0)
    medoid = int(np.argmin(np.einsum("ij,ij->i", x - middle, x - middle)))
    order = rng.permutation(n)
    size, at = 16, 0
    start = np.array([medoid])
    order = np.concatenate([start, order[order != medoid]])
    while at < n:
        batch = order[at : at + size]
        at, size = at + size, min(256, max(16, at))
        ids, _, _ = beam_search(x, graph, start, x[batch])
        inside = np.sort(batch)
        for p, found in zip(batch.tolist(), ids, strict=True):
            # Points of one batch don't find each other: they are candidates of one another as well.
            c = np.unique(np.concatenate([found[found < n], graph[p, : used[p]], inside]))
            kept = prune(x, p, c)
            graph[p, : len(kept)], graph[p, len(kept) :], used[p] = kept, -1, len(kept)
            for j in kept.tolist():
                if p in graph[j, : used[j]]:
                    continue
                if used[j] == slack:
                    again = prune(x, j, np.append(graph[j], p))
                    graph[j], used[j] = -1, len(again)
                    graph[j, : len(again)] = again
                else:
                    graph[j, used[j]] = p
                    used[j] += 1
    for j in np.flatnonzero(used > DEGREE).tolist():
        again = prune(x, j, graph[j, : used[j]])
        graph[j], used[j] = -1, len(again)
        graph[j, : len(again)] = again
    return graph[:, :DEGREE], _starts(graph[:, :DEGREE], medoid)


def _starts(graph: np.ndarray, first: int) -> np.ndarray:
    """first, and a node for each part of the graph that no walk from those before it enters: with them a search can reach every node."""
    met, out, at = np.zeros(len(graph) + 1, dtype=bool), [], first
    met[-1] = True  # stands for the padding, -1
    while True:
        out.append(at)
        met[at] = True
        front = np.array([at])
        while len(front):
            front = np.unique(graph[front])
            front = front[~met[front]]
            met[front] = True
        left = np.flatnonzero(~met)
        if not len(left):
            return np.array(out)
        at = int(left[0])


def _vectors(frame: pd.DataFrame) -> np.ndarray:
    return np.array(frame["v"].tolist(), dtype=np.float64)


def _centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(x scaled by a power of two to about 1 and centred, in single precision; the middle; the power): neither large nor tiny
    components leave the range of squares."""
    power = int(np.frexp(np.abs(x).max())[1])
    scaled = np.ldexp(x, -power)
    middle = scaled.mean(axis=0)
    return (scaled - middle).astype(np.float32), middle, power


def _reached(q: np.ndarray, middle: np.ndarray, power: int) -> np.ndarray:
    """Queries in a shard's scale: in single precision, or in double precision and at most FAR if some lie far outside the shard."""
    large = np.frexp(np.abs(q).max(axis=1))[1] - power
    down = np.maximum(large - FAR, 0)  # beyond that only the direction counts
    out = np.ldexp(np.ldexp(q, -(power // 2) - down[:, None]), power // 2 - power) - middle  # in two steps, each within range
    return out if large.max() > NEAR else out.astype(np.float32)


def _exact(x: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; the scaling by a power of two changes no digit."""
    diff = x - vector
    power = int(np.frexp(np.abs(diff).max(initial=0.0))[1])
    return np.ldexp(np.sqrt((np.ldexp(diff, -power) ** 2).sum(axis=1)), power)


def _index(frame: pd.DataFrame) -> pd.DataFrame:
    """One packed row of a shard."""
    frame = frame.sort_values("rep", kind="stable")
    x = _vectors(frame)
    graph, start = build(_centred(x)[0])
    members = [list(m) for m in frame["members"]]
    return pd.DataFrame({
        "shard": [frame["shard"].iloc[0]], "n": [len(x)], "vectors": [x.tobytes()], "graph": [graph.astype("<i4").tobytes()], "start": [start.astype("<i4").tobytes()],
        "members": [np.concatenate(members).astype("<i8").tobytes()], "sizes": [np.array([len(m) for m in members], "<i4").tobytes()],
    })


_INDEX = "shard string, n long, vectors binary, graph binary, start binary, members binary, sizes binary"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v as array<double>, dim): one row for each id of a vector that takes part."""
    v = integer_ids(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "vec_id")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda c: c != 0)).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def build_index(vectors: DataFrame, k: int = K, shard: int = SHARD) -> DataFrame:
    """A table of packed shards over all rows of ``usable`` vectors."""
    # -0.0 and 0.0 are the same place; k + 1 members of a node are enough for any query.
    # (A limit per vector before the shuffle: copies of one vector don't meet in one task.)
    same = W.partitionBy("v").orderBy("vec_id")
    few = vectors.withColumn("v", F.transform("v", lambda c: c + F.lit(0.0))).withColumn("k", F.row_number().over(same)).where(F.col("k") <= k + 1)
    nodes = few.groupBy("v", "dim").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("members"))
    nodes = written(nodes, "nodes")
    sized = nodes.withColumn("size", F.floor(F.log2(F.array_max(F.transform("v", F.abs))) / MAGNITUDE))
    shards = sized.groupBy("dim", "size").agg(F.ceil(F.count("*") / shard).alias("shards"))
    dealt = sized.join(shards, ["dim", "size"]).withColumn("shard", F.concat_ws("-", "dim", F.pmod(F.xxhash64("rep"), F.col("shards")), "size"))
    return written(dealt.select("shard", "rep", "v", "members").groupBy("shard").applyInPandas(_index, _INDEX), "index")


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qid = np.frombuffer(row["ids"], "<i8")
                q = np.frombuffer(row["queries"], "<f8").reshape(len(qid), -1)
                x = np.frombuffer(row["vectors"], "<f8").reshape(row["n"], -1)
                graph = np.frombuffer(row["graph"], "<i4").reshape(row["n"], -1).astype(np.int64)
                members, sizes = np.frombuffer(row["members"], "<i8"), np.frombuffer(row["sizes"], "<i4").astype(np.int64)
                ends = np.cumsum(sizes)
                start = np.frombuffer(row["start"], "<i4").astype(np.int64)
                near, middle, power = _centred(x)
                single = _reached(q, middle, power)
                near = near.astype(single.dtype)
                out: list[tuple[int, int, float]] = []
                for at in range(0, len(q), 128):
                    ids, _, _ = beam_search(near, graph, start, single[at : at + 128], SEARCH)
                    for mine, vector, found in zip(qid[at : at + 128].tolist(), q[at : at + 128], ids, strict=True):
                        found = found[found < row["n"]]
                        exact = _exact(x[found], vector)
                        nodes = np.repeat(np.arange(len(found)), sizes[found])
                        vec = np.concatenate([members[ends[f] - sizes[f] : ends[f]] for f in found.tolist()])
                        other = vec != mine
                        vec, d = vec[other], exact[nodes][other]
                        best = np.lexsort((vec, d))[:k]
                        out += [(mine, int(v), float(s)) for v, s in zip(vec[best], d[best], strict=True)]
                columns = zip(*out, strict=True) if out else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    return run


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("vec_id", kind="stable")
    return pd.DataFrame({"block": [frame["block"].iloc[0]], "dim": [frame["dim"].iloc[0]], "ids": [frame["vec_id"].to_numpy("<i8").tobytes()], "queries": [_vectors(frame).tobytes()]})


def search(queries: DataFrame, index: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query; queries as ``usable`` gives them."""
    blocks = queries.agg(F.ceil(F.count("*") / BLOCK).alias("n")).first()["n"]
    packed = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks)))).groupBy("block", "dim").applyInPandas(_pack, "block long, dim int, ids binary, queries binary")
    shards = index.select(F.split("shard", "-")[0].cast("int").alias("dim"), "shard")
    visits = packed.join(shards, "dim").select("ids", "queries", "shard")  # a row for each block and shard of its length
    found = visits.join(index, "shard").mapInArrow(_search(k), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_ann_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(vectors.where(F.col("vec_id") % 100 == 0), build_index(vectors))
