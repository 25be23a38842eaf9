"""Exact dedup by composable polynomial fingerprints.

A text's UTF-8 bytes b_0..b_(n-1) have the fingerprint sum(b_i * r^(n-1-i)) mod p for two pairs (p, r).
Chunks are hashed on their own and combined by length-shifted arithmetic, H(xy) = H(x) * r^|y| + H(y), so
the chunks of a huge document can be hashed in any order or place. Texts of equal length and fingerprint
are then compared chunk by chunk: the chunks of one group and position meet in one aggregate, which keeps their least and
greatest contents only (map-side first, so copies never pile up in one task). Texts without a partner don't move, but for those
that a filter of fixed size lets through. A group of which any position has two contents is split by the whole text.

Null and odd input: a null text counts as empty; the empty text is a text like any other, so all empty and
null texts form one group. Rows repeated with the same doc_id and text count as rows in group_size and get
the same verdict; ``deduplicate`` keeps one of them. A null doc_id is smaller than any other. An empty table
gives an empty result. Further columns of the input, whatever their names, are carried only by ``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import claim, documents, integer_ids, written
from engram.llm.filters import may_hold, row_filter
from engram.llm.shingles import mixed

#: Two primes below 2^31 and the bases; a product with a byte stays below 2^39, a sum over a chunk below 2^55.
MODULI = ((2147483647, 1103515245), (2147483629, 1664525))
CHUNK = 1 << 16

_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(p: int, r: int) -> np.ndarray:
    """r^(CHUNK-1) .. r^0 mod p."""
    if (p, r) not in _powers:
        out = np.ones(CHUNK, dtype=np.int64)
        filled, step = 1, r % p
        while filled < CHUNK:  # doubles: r^(filled+i) = r^filled * r^i
            take = min(filled, CHUNK - filled)
            out[filled : filled + take] = out[:take] * step % p
            filled, step = filled + take, step * step % p
        _powers[p, r] = out[::-1].copy()
    return _powers[p, r]


def chunk_hash(chunk: bytes, p: int, r: int) -> int:
    a = np.frombuffer(chunk, dtype=np.uint8).astype(np.int64)
    return int(a @ powers(p, r)[CHUNK - len(a) :]) % p


def combine(left: int, right: int, right_len: int, p: int, r: int) -> int:
    """The hash of a concatenation from the hashes of its parts."""
    return (left * pow(r, right_len, p) + right) % p


def fingerprint(data: bytes, moduli: tuple[tuple[int, int], ...] = MODULI) -> int:
    """Both hashes in one signed 64-bit integer."""
    parts = []
    for p, r in moduli:
        h = 0
        for i in range(0, len(data), CHUNK):
            c = data[i : i + CHUNK]
            h = combine(h, chunk_hash(c, p, r), len(c), p, r)
        parts.append(h)
    return (parts[0] << 31 | parts[1]) - (1 << 61)


def _hash_of(fp: int, n: int) -> np.uint64:
    return mixed(np.array([fp], dtype=np.int64).view(np.uint64) + np.uint64(n))[0]


def _chunks(moduli: tuple[tuple[int, int], ...], wanted: Broadcast):
    """A row for each chunk of the texts whose fingerprint the filter of wanted ones may hold."""
    names, types = ["fp", "n_bytes", "chunk_no", "chunk"], [pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("exact_dedup", _powers.clear)
        table = wanted.value
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for data in b.column(0).cast(pa.binary()).to_pylist():
                data = data or b""
                fp, n = fingerprint(data, moduli), len(data)
                if not may_hold(table, np.array([_hash_of(fp, n)]))[0]:
                    continue
                for k, at in enumerate(range(0, n, CHUNK)):
                    rows.append((fp, n, k, data[at : at + CHUNK]))
                    held += min(n - at, CHUNK)
                    if held > 8 << 20:
                        yield _batch(rows, names, types)
                        rows, held = [], 0
            yield _batch(rows, names, types)

    return run


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _digests(moduli: tuple[tuple[int, int], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("exact_dedup", _powers.clear)
        for b in batches:
            data = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            arrays = [
                b.column(0),
                pa.array([fingerprint(x, moduli) for x in data], pa.int64()),
                pa.array([len(x) for x in data], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string()),
            ]
            row = [int(_hash_of(f, n).view(np.int64)) for f, n in zip(arrays[1].to_pylist(), arrays[2].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(row, pa.int64())], ["doc_id", "fp", "n_bytes", "sha", "row"])

    return run


def duplicate_groups(docs: DataFrame, moduli: tuple[tuple[int, int], ...] = MODULI) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row; see the module's docstring."""
    source = integer_ids(docs.select("doc_id", "text"), "doc_id")
    digests = written(source.mapInArrow(_digests(moduli), "doc_id long, fp long, n_bytes long, sha string, row long"), "digests")
    several = digests.groupBy("fp", "n_bytes").agg(F.count("*").alias("c"), F.first("row").alias("row")).where("c > 1")
    wanted = source.sparkSession.sparkContext.broadcast(row_filter(several))
    suspect = (
        source.select("text").mapInArrow(_chunks(moduli, wanted), "fp long, n_bytes long, chunk_no int, chunk binary")
        .groupBy("fp", "n_bytes", "chunk_no")
        .agg(F.min("chunk").alias("least"), F.max("chunk").alias("greatest"))
        .where("least <> greatest")
        .select("fp", "n_bytes", F.lit(True).alias("suspect"))
        .distinct()
    )
    # A suspect group falls apart by the digest of the whole text. Both sides of the last join are written
    # tables, so that Spark can split the partition of a hot group.
    keyed = written(
        digests.join(suspect, ["fp", "n_bytes"], "left").select(
            "doc_id", "fp", "n_bytes", "sha", F.when(F.col("suspect"), F.col("sha")).otherwise("").alias("part")
        ),
        "fingerprints",
    )
    groups = written(
        keyed.groupBy("fp", "n_bytes", "part")
        .agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
        .where("group_size > 1"),
        "groups",
    )
    return keyed.join(groups, ["fp", "n_bytes", "part"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with all their columns."""
    found = written(duplicate_groups(docs).select("doc_id", "text_sha256", "kept"), "verdicts")
    keys = [F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")]
    gone = found.where(~F.col("kept")).select(*keys).distinct()
    again = found.where("kept").groupBy(*keys).count().where("count > 1").select("_id", "_sha")
    sha = F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)

    def same(side: DataFrame):
        return docs["doc_id"].cast("long").eqNullSafe(side["_id"]) & (sha == side["_sha"])

    rest = docs.join(gone, same(gone), "left_anti")
    if not again.limit(1).count():
        return rest
    # Rows repeated with the id and text that stay: one of them.
    again = written(again, "again")
    once = docs.join(again, same(again), "left_semi").withColumn("_sha", sha).dropDuplicates(["doc_id", "_sha"]).drop("_sha")
    return rest.join(again, same(again), "left_anti").unionByName(once)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(documents(spark, sf_dir))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
