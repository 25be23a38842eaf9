"""Exact k-means over integer vectors by Exponion search.

Components become the integers floor(SCALE * x), and all that decides is exact: squared distances, ties (the smaller number), and
centroids, which are floors of exact means. Each vector keeps its centroid, an upper bound on the distance to it and a lower
bound on that to all others. A round moves the bounds by how far the centroids moved; only where the upper bound reaches both the lower
one and half the way from the centroid to its nearest fellow is the vector looked at again: first its own distance, then the
centroids in a ball around its own one, of radius twice that distance and the way to the nearest fellow, radius included. Each
centroid has the others in a list by distance, so a ball is a beginning of that list; its length is rounded up to a power of
two, so vectors are scanned together. Bounds are rounded outwards.

Vectors are packed into blocks where they are read; a round maps blocks to blocks, in a written table that takes the place of the one
before, and gives sums of each block. The driver sees the sums of k clusters, k x DIM numbers; nothing is shuffled but these.

Null and odd input: vectors that are null, of another length, hold a null or non-finite component, or an integer that does not fit 64 bits take no
part. Blocks of components beyond NARROW are scanned whole in Python's integers; a distance or an inertia that does not fit 64 bits is
null. A null vec_id is clustered, and comes last in the choice of first centroids; equal hashes (repeated ids) go by the vector. With
fewer than k vectors there are as many centroids; an empty table gives an empty result. Only vec_id and embedding are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import delete, integer_ids, written

K, ROUNDS, DIM, SCALE, SEED, BLOCK = 8, 10, 64, 1024, "3", 4096
#: Up to here sums of 64 squared differences are exact in double precision.
NARROW = 1 << 22
#: By which bounds are rounded outwards; far above what a few operations can err.
SLACK = 1e-12
_BLOCK = "ids array<long>, narrow boolean, vectors binary"
_STATE = f"{_BLOCK}, cluster binary, upper binary, lower binary, sums array<struct<cluster: int, n: long, high: array<long>, low: array<long>>>"
_RESULT = "vec_id long, cluster int, distance long"


def kept(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles."""
    v = integer_ids(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "vec_id").where(F.size("v") == dim)
    return v.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float((1 << 63) // scale))))


def packed(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """Blocks of at most BLOCK vectors as integers, packed where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x = np.floor(scale * b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)).astype(np.int64)
                narrow = ((x <= NARROW) & (x >= -NARROW)).all(axis=1)
                rows = [(kind, np.flatnonzero(narrow == kind)) for kind in (True, False)]
                rows = [(kind, r) for kind, r in rows if len(r)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b.column(0).take(pa.array(r)).to_pylist() for _, r in rows], pa.list_(pa.int64())), pa.array([kind for kind, _ in rows], pa.bool_()),
                        pa.array([x[r].astype("<i4" if kind else "<i8").tobytes() for kind, r in rows], pa.binary()),
                    ], ["ids", "narrow", "vectors"],
                )

    return vectors.mapInArrow(run, _BLOCK)


def first_centroids(vectors: DataFrame, k: int = K, scale: int = SCALE, seed: str = SEED) -> list[list[int]]:
    """k vectors by the hash of their ids; k rows go to the driver."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(order.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return [np.floor(scale * np.array(r["v"])).astype(np.int64).tolist() for r in rows]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x and c, both doubles up to NARROW or both Python's integers."""
    return (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)


@dataclass
class Model:
    """The centroids of a round, how far each moved to get there, and the others of each by distance."""

    centroids: list[list[int]]
    moved: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.narrow = all(abs(y) <= NARROW for c in self.centroids for y in c)
        exact = np.array(self.centroids, dtype=object)
        between = np.sqrt(squared(exact, exact).astype(np.float64))
        self.order = np.argsort(between, axis=1, kind="stable")
        self.near = np.take_along_axis(between, self.order, axis=1)
        self.half = self.near[:, 1] / 2 if len(exact) > 1 else np.full(1, np.inf)
        self.doubles = np.array(self.centroids, dtype=np.float64)

    def next(self, sums: dict[int, tuple[int, list[int]]]) -> Model:
        """After a round; sums: number and componentwise sums of each non-empty cluster."""
        new = [[s // sums[j][0] for s in sums[j][1]] if j in sums else old for j, old in enumerate(self.centroids)]
        apart = [sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for p, q in zip(new, self.centroids, strict=True)]
        return Model(new, np.sqrt(np.array(apart, dtype=np.float64)) * (1 + SLACK))


def drifted(m: Model, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds after the centroids moved: by its own for the upper one, by the farthest other's for the lower one."""
    order = np.argsort(-m.moved, kind="stable")
    most, second = m.moved[order[0]], m.moved[order[1]] if len(order) > 1 else 0.0
    return (upper + m.moved[cluster]) * (1 + SLACK), (lower - np.where(cluster == order[0], second, most)) * (1 - SLACK) - SLACK


def exponion(m: Model, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, distances worked out) of rows of x, doubles, after a round."""
    cluster, upper, lower, k = cluster.copy(), upper.copy(), lower.copy(), len(m.centroids)
    bar = lambda rows: np.maximum(lower[rows], m.half[cluster[rows]] * (1 - SLACK))
    rows = np.flatnonzero(~(upper < bar(slice(None))))
    diff = x[rows] - m.doubles[cluster[rows]]
    upper[rows] = np.sqrt(np.einsum("ij,ij->i", diff, diff)) * (1 + SLACK)
    done = len(rows)
    rows = rows[~(upper[rows] < bar(rows))]
    own = cluster[rows]
    radius = 2 * (upper[rows] + m.half[own]) * (1 + SLACK)
    for j in np.unique(own).tolist():
        mine, reach = rows[own == j], np.searchsorted(m.near[j], radius[own == j], side="right")
        reach = np.minimum(k, np.left_shift(1, np.ceil(np.log2(reach)).astype(np.int64)))
        for many in np.unique(reach).tolist():
            some, ball = mine[reach == many], np.sort(m.order[j, :many])
            d = squared(x[some], m.doubles[ball])
            done += d.size
            best = d.argmin(axis=1)  # the first of equal ones, so the smallest number
            at = np.arange(len(some))
            upper[some] = np.sqrt(d[at, best]) * (1 + SLACK)
            d[at, best] = np.inf
            lower[some] = np.sqrt(d.min(axis=1)) * (1 - SLACK)
            cluster[some] = ball[best]
    return cluster, upper, lower, done


def _vectors(row: dict) -> np.ndarray:
    return np.frombuffer(row["vectors"], "<i4" if row["narrow"] else "<i8").reshape(len(row["ids"]), -1)


def _sums(x: np.ndarray, cluster: np.ndarray) -> list[dict]:
    """Of each cluster the sums of the high and the low 32 bits, so that no sum of a block overflows."""
    out, x = [], x.astype(np.int64)
    for j in np.unique(cluster).tolist():
        y = x[cluster == j]
        out.append({"cluster": j, "n": len(y), "high": (y >> 32).sum(axis=0).tolist(), "low": (y & 0xFFFFFFFF).sum(axis=0).tolist()})
    return out


def _round(m: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of _BLOCK (the first round) or _STATE -> _STATE."""
    sums = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(m.centroids, dtype=object)
        for batch in batches:
            for row in batch.to_pylist():
                x, n = _vectors(row), len(row["ids"])
                if m.narrow and row["narrow"]:
                    cluster, upper, lower = np.zeros(n, dtype=np.int32), np.full(n, np.inf), np.zeros(n)
                    if row.get("cluster") is not None:
                        cluster, upper, lower = (np.frombuffer(row[c], kind) for c, kind in (("cluster", "<i4"), ("upper", "<f8"), ("lower", "<f8")))
                        upper, lower = drifted(m, cluster, upper, lower)
                    cluster, upper, lower, _ = exponion(m, x.astype(np.float64), cluster, upper, lower)
                else:
                    cluster = squared(x.astype(object), exact).argmin(axis=1).astype(np.int32)
                    upper, lower = np.full(n, np.inf), np.zeros(n)
                state = [pa.array([v.astype(kind).tobytes()], pa.binary()) for v, kind in ((cluster, "<i4"), (upper, "<f8"), (lower, "<f8"))]
                block = [pa.array([row["ids"]], pa.list_(pa.int64())), pa.array([row["narrow"]]), pa.array([row["vectors"]], pa.binary())]
                yield pa.RecordBatch.from_arrays([*block, *state, pa.array([_sums(x, cluster)], sums)], ["ids", "narrow", "vectors", "cluster", "upper", "lower", "sums"])

    return run


def _gathered(state: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number and componentwise sums of each cluster: k x DIM rows to the driver."""
    parts = state.select(F.inline("sums")).select("cluster", "n", F.posexplode(F.arrays_zip("high", "low")).alias("i", "s"))
    whole = parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), *[F.sum(F.col(f"s.{c}").cast("decimal(20,0)")).alias(c) for c in ("high", "low")])
    out: dict[int, tuple[int, dict[int, int]]] = {}
    for r in whole.collect():
        out.setdefault(r["cluster"], (r["n"], {}))[1][r["i"]] = (int(r["high"]) << 32) + int(r["low"])
    return {j: (n, [s[i] for i in range(len(s))]) for j, (n, s) in out.items()}


def _assigned(m: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(m.centroids, dtype=object)
        for batch in batches:
            for row in batch.to_pylist():
                x, cluster = _vectors(row), np.frombuffer(row["cluster"], "<i4")
                if m.narrow and row["narrow"]:
                    diff = x - np.array(m.centroids, dtype=np.int64)[cluster]
                    distance = np.einsum("ij,ij->i", diff, diff).tolist()
                else:
                    distance = ((x.astype(object) - exact[cluster]) ** 2).sum(axis=1).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(cluster, pa.int32()), pa.array([d if d < 1 << 63 else None for d in distance], pa.int64())], ["vec_id", "cluster", "distance"]
                )

    return run


def kmeans(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of each vector that takes part, the final centroids)."""
    spark, whole = vectors.sparkSession, kept(vectors, dim, scale)
    centroids = first_centroids(whole, k, scale, seed)
    if not centroids:
        return spark.createDataFrame([], _RESULT), []
    m, state = Model(centroids), written(packed(whole, dim, scale), "kmeans-blocks")
    for r in range(rounds + 1):
        after = written(state.mapInArrow(_round(m), _STATE), f"kmeans-{r}")
        delete(spark, state)
        state = after
        if r < rounds:
            m = m.next(_gathered(state))
    out = written(state.select("ids", "narrow", "vectors", "cluster").mapInArrow(_assigned(m), _RESULT), "kmeans")
    delete(spark, state)
    return out, m.centroids


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part."""
    spark = vectors.sparkSession
    assigned, centroids = kmeans(vectors, k, rounds)
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    whole = F.when(F.count("distance") == F.count("*"), total)
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(whole.alias("s")).collect()}  # k rows
    every = None if None in sums.values() else sum(int(s) for s in sums.values())
    fits = lambda s: None if s is None or s >= 1 << 63 else int(s)
    about = [(j, fits(sums.get(j)), fits(every), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    table = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT rid, vec_id, v, min({{'d': list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'j': j}}) AS best FROM kept, c{r} GROUP BY ALL)""")
        if r < ROUNDS:
            steps.append(f"""s{r} AS (SELECT j, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT best.j AS j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY ALL),
m{r} AS (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{r} GROUP BY j),
c{r + 1} AS MATERIALIZED (SELECT o.j, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m ON m.j = o.j)""")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {K})),
{', '.join(steps)},
last AS (SELECT vec_id, best.j AS j, best.d AS distance FROM a{ROUNDS})
SELECT vec_id, l.j::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY l.j))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM last l JOIN c{ROUNDS} c ON c.j = l.j"""


OP13_SQL = _sql()
