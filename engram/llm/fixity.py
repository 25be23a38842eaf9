"""Merkle fixity audit of WARC archives.

A page becomes a WARC response record; records lie in archives (by the first hex digits of the id's md5) at running offsets,
in the order of page_id, then of their hash. A replica is a table of records that names the same archives and offsets. Each record is hashed
(SHA-256), the records of a byte range of RANGE offsets make a leaf, FANOUT nodes in offset order make a node of
the next level, up to one root of each archive: LEVELS levels, or for all archives as many more as the longest needs. The audit compares roots, then only the children of nodes that differ,
level by level, and at last the records of the ranges found: altered, missing or extra. All of it is DataFrame
aggregation and equi-joins; hashes are made once, and no task needs a whole archive.

Null and odd input: null url or html count as empty, a null page_id sorts first and counts as id -1 in its archive;
pages repeated with one id have records of their own, told apart by offset; an empty table has no roots and no findings;
only page_id, url and html are read. An archive known to one side only is found whole, record by record.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.llm.common import integer_ids, written

#: Hex digits that name an archive, bytes of a leaf's range, children of a node, levels above the leaves at least.
DIGITS, RANGE, FANOUT, LEVELS = 2, 65536, 64, 3
#: Ranges of ids, between approximate percentiles, in which offsets are summed up; what stands for a null id there.
RANGES, NO_ID = 1024, -(1 << 63)


def _md5(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def records(pages: DataFrame) -> DataFrame:
    """(archive, page_id, record, length): pages as WARC records."""
    rows = integer_ids(pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")), "page_id")
    name = F.coalesce("page_id", F.lit(-1))
    digest = _md5(name, F.lit("record"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"),
        F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]),
        F.lit(">\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"),
    )
    return rows.select(
        F.substring(_md5(name), 1, DIGITS).alias("archive"), "page_id", F.concat(head, F.col("html"), F.lit("\r\n\r\n")).alias("record")
    ).withColumn("length", F.octet_length("record").cast("long"))


def placed(rows: DataFrame) -> DataFrame:
    """(archive, page_id, length, sha, offset): the records' hashes at their place. Records are hashed where they are read; only
    hashes move."""
    own = [c for c in rows.columns if c not in ("record", "page_id", "archive", "length")]
    hashed = rows.select("archive", "page_id", "length", F.sha2("record", 256).alias("sha"), *own)
    # Running sums in three steps: records of one id and first digit of the hash, these cells of a range of ids, ranges of an archive.
    # So neither an archive nor the copies of one id are in one task.
    hashed = written(hashed.withColumn("_id", F.coalesce("page_id", F.lit(NO_ID))).withColumn("_digit", F.substring("sha", 1, 1)), "hashed")
    hashed = hashed.withColumn("_range", _range(_bounds(hashed)))
    cells = _before(hashed.groupBy("archive", "_range", "_id", "_digit").agg(F.sum("length").alias("n")), "n", ["archive", "_range"], "_id", "_digit")
    sums = _before(hashed.groupBy("archive", "_range").agg(F.sum("length").alias("n")), "n", ["archive"], "_range")
    own = _before(hashed, "length", ["archive", "_id", "_digit"], "sha", "length").withColumnRenamed("before", "own")
    cells = cells.select("archive", "_id", "_digit", F.col("before").alias("cell"))
    sums = sums.select("archive", "_range", F.col("before").alias("range"))
    out = own.join(cells, ["archive", "_id", "_digit"]).join(sums, ["archive", "_range"])
    return out.select(*rows.drop("record").columns, "sha", (F.col("own") + F.col("cell") + F.col("range")).alias("offset"))


def _bounds(rows: DataFrame) -> list[int]:
    """Percentiles of page_id, ascending: fewer than RANGES of them, so that ranges hold like numbers of records however ids lie."""
    found = rows.agg(F.percentile_approx("page_id", [k / RANGES for k in range(1, RANGES)], 10 * RANGES)).first()[0]
    return sorted(set(found or []))


def _range(bounds: list[int]) -> Column:
    """A number that grows with page_id and is the same between two bounds, looked for in two steps; -1 for null."""
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    longs = [F.array(*map(F.lit, g)).cast("array<long>") for g in [*groups, []]]
    tops = F.array(*[F.lit(g[-1]) for g in groups]).cast("array<long>")
    skipped = F.size(F.filter(tops, lambda b: b < F.col("page_id")))
    inner = F.element_at(F.array(*longs), skipped + 1)
    return F.when(F.col("page_id").isNull(), -1).otherwise(skipped * step + F.size(F.filter(inner, lambda b: b < F.col("page_id"))))


def _before(rows: DataFrame, value: str, within: list[str], *order: str) -> DataFrame:
    """rows with ``before``: the sum of the values that come before each in its partition."""
    before = W.partitionBy(*within).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum(value).over(before), F.lit(0)))


def _ordered(order: str, value: str) -> Column:
    """SHA-256 of the values of a group in the order of a column; a group is a range or FANOUT nodes."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: F.concat_ws(":", x[order].cast("string"), x[value]))
    return F.sha2(F.array_join(lines, "\n"), 256)


def ranges(leaves: DataFrame) -> DataFrame:
    """(archive, node, hash) of the ranges of RANGE offsets."""
    ranged = leaves.withColumn("node", F.floor(F.col("offset") / RANGE))
    return written(ranged.groupBy("archive", "node").agg(_ordered("offset", "sha").alias("hash")), "ranges")


def height(*tables: DataFrame) -> int:
    """The levels above the ranges at which each archive of all tables is a single node; LEVELS at least."""
    last, out = max(t.agg(F.max("node")).first()[0] or 0 for t in tables), 0
    while last:
        last, out = last // FANOUT, out + 1
    return max(out, LEVELS)


def tree(ranged: DataFrame, above: int) -> list[DataFrame]:
    """(archive, node, hash) of each level, from the ranges to the roots (node 0 of the last level)."""
    levels = [ranged]
    for _ in range(above):
        up = levels[-1].withColumn("child", F.col("node")).withColumn("node", F.floor(F.col("node") / FANOUT))
        levels.append(written(up.groupBy("archive", "node").agg(_ordered("child", "hash").alias("hash")), "level"))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    return levels[-1].select("archive", F.col("hash").alias("root"))


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(archive, node) whose hashes differ or that one side lacks."""
    left, right = a.withColumnRenamed("hash", "a_hash"), b.withColumnRenamed("hash", "b_hash")
    return left.join(right, ["archive", "node"], "full").where(~F.col("a_hash").eqNullSafe(F.col("b_hash"))).select("archive", "node")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(archive, offset, page_id, status, primary_sha256, replica_sha256, primary_root, replica_root) of each record that is
    not the same in both; both inputs are as ``placed`` gives them."""
    a, b = ranges(primary), ranges(replica)
    above = height(a, b)
    a, b = tree(a, above), tree(b, above)
    wrong = _differing(a[-1], b[-1])
    for x, y in zip(a[-2::-1], b[-2::-1], strict=True):
        parent = F.floor(F.col("node") / FANOUT)
        below = wrong.withColumnRenamed("node", "parent")
        here = [t.withColumn("parent", parent).join(below, ["archive", "parent"], "left_semi").drop("parent") for t in (x, y)]
        wrong = _differing(*here)
    wrong = written(wrong, "findings")
    node = F.floor(F.col("offset") / RANGE)
    p, r = [t.withColumn("node", node).join(wrong, ["archive", "node"], "left_semi").drop("node") for t in (primary, replica)]
    p = p.select("archive", "offset", F.col("page_id").alias("p_id"), F.col("sha").alias("primary_sha256"))
    r = r.select("archive", "offset", F.col("page_id").alias("r_id"), F.col("sha").alias("replica_sha256"))
    found = p.join(r, ["archive", "offset"], "full").where(~F.col("primary_sha256").eqNullSafe(F.col("replica_sha256")))
    status = F.when(F.col("replica_sha256").isNull(), "missing").when(F.col("primary_sha256").isNull(), "extra").otherwise("altered")
    pr, rr = roots(a).withColumnRenamed("root", "primary_root"), roots(b).withColumnRenamed("root", "replica_root")
    return (
        found.join(pr, "archive", "left").join(rr, "archive", "left")
        .select("archive", "offset", F.coalesce("p_id", "r_id").alias("page_id"), status.alias("status"), "primary_sha256", "replica_sha256", "primary_root", "replica_root")
    )


def damaged(rows: DataFrame) -> DataFrame:
    """A replica of records with known faults: by a hash of the id one in 64 has a byte changed; gone marks one in 256."""
    lot = F.conv(F.substring(_md5(F.coalesce("page_id", F.lit(-1)), F.lit("rot")), 1, 4), 16, 10).cast("int")
    rotten = F.concat(F.lit("w"), F.expr("substring(record, 2)"))
    return rows.withColumn("gone", lot % 256 == 7).withColumn("record", F.when(lot % 64 == 3, rotten).otherwise(F.col("record")))


def op2_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    replica = placed(damaged(rows)).where(~F.col("gone")).drop("gone")
    return audit(written(placed(rows), "primary"), written(replica, "replica"))


def _tree_sql(side: str) -> str:
    out = f"""{side}_0 AS (SELECT archive, "offset" // {RANGE} AS node,
  sha256(string_agg("offset" || ':' || sha, chr(10) ORDER BY "offset")) AS hash FROM {side} GROUP BY ALL)"""
    for k in range(LEVELS):
        out += f""",
{side}_{k + 1} AS (SELECT archive, node // {FANOUT} AS node,
  sha256(string_agg(child || ':' || hash, chr(10) ORDER BY child)) AS hash
  FROM (SELECT archive, node, node AS child, hash FROM {side}_{k}) GROUP BY archive, node // {FANOUT})"""
    return out


OP2_SQL = f"""
WITH made AS (
  SELECT substr(md5(page_id::VARCHAR), 1, {DIGITS}) AS archive, page_id, md5(page_id || ':record') AS d, coalesce(url, '') AS url, coalesce(html, '') AS html,
         ('0x' || substr(md5(page_id || ':rot'), 1, 4))::INT AS lot FROM pages),
warc AS (
  SELECT archive, page_id, lot, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:'
    || substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-' || substr(d, 13, 4) || '-' || substr(d, 17, 4) || '-' || substr(d, 21, 12) || '>'
    || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM made),
placed AS (
  SELECT *, coalesce(sum(strlen(record)) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM warc),
a AS (SELECT archive, "offset", page_id, sha256(record) AS sha FROM placed),
b AS (SELECT archive, "offset", page_id, sha256(CASE WHEN lot % 64 = 3 THEN 'w' || substr(record, 2) ELSE record END) AS sha FROM placed WHERE lot % 256 <> 7),
{_tree_sql("a")},
{_tree_sql("b")}
SELECT a.archive, a."offset", a.page_id, CASE WHEN b.sha IS NULL THEN 'missing' ELSE 'altered' END AS status,
  a.sha AS primary_sha256, b.sha AS replica_sha256, ra.hash AS primary_root, rb.hash AS replica_root
FROM a LEFT JOIN b ON a.archive = b.archive AND a."offset" = b."offset"
LEFT JOIN a_{LEVELS} ra ON ra.archive = a.archive LEFT JOIN b_{LEVELS} rb ON rb.archive = a.archive
WHERE a.sha IS DISTINCT FROM b.sha
"""
