"""SimHash fingerprints, and all fingerprints within a Hamming radius (DataFrame functions only).

A text's terms are its lower-cased words, cut into pieces of at most PIECE characters, and each two terms in a row. Each term
has a hash of BITS bits; every occurrence votes with its weight on each bit, for it or against it, and the signs of the sums
are the fingerprint (a tie is 0). Votes are counted by sums only: 32 bits of a hash apart, two votes share a long.

``neighbours`` finds, for each fingerprint, those within RADIUS bits: bits are cut into blocks, and each choice of
blocks - RADIUS blocks is a table keyed by them; two fingerprints within the radius agree in one table at least, and are
counted in the first in which they do. Buckets are cut into parts of about PART fingerprints that meet part by part inside
expressions, so no row is made for a pair. More blocks than RADIUS + 1 make longer keys and more tables.

``edited`` replaces the last quarter of each text by the beginning of the next document's, in the order of doc_id (nulls last),
then of the text's hash. Documents are dealt to cells between approximate percentiles of doc_id; an id that is itself a bound has a cell of
its own, and such cells and that of null ids are cut by the text's hash, so no id gathers in one task. The next of a cell's last
document is the first of the next cell.

Null and odd input: a null text is empty; an empty text has the fingerprint 0 and is its own edited text; null doc_ids are
documents; of repeated rows each is the next of the one before; a single document is its own next. An empty table gives an
empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.llm.common import documents, shuffle_partitions, written

BITS, RADIUS, BLOCKS, PART = 128, 3, 4, 512
PIECE, WORD_WEIGHT, PAIR_WEIGHT = 16, 1, 3
#: Cells for each shuffle partition, at most; parts of a cell that holds one id.
CELLS, MOST_CELLS, SUBS = 8, 4096, 256
#: One vote in each half of a long.
_LANES = (1 << 32) | 1


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0))


def fingerprints(texts: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, f0, f1): the fingerprint of each row's text in two longs; rows alike in keys are one text."""
    cut = texts.select(*keys, terms(F.col(text)).alias("w"))
    pairs = cut.select(*keys, F.inline_outer(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))))
    word, pair = F.when(F.col("a").isNotNull(), WORD_WEIGHT).otherwise(0), F.when(F.col("b").isNotNull(), PAIR_WEIGHT).otherwise(0)
    hashed = pairs.select(
        *keys, word.cast("long").alias("ww"), pair.cast("long").alias("pw"),
        *[h.alias(f"{k}{i}") for i in range(2) for k, h in (("h", F.xxhash64(F.lit(i), "a")), ("g", F.xxhash64(F.lit(i), "a", "b")))],
    )
    vote = lambda i, j: F.expr(f"sum((shiftrightunsigned(h{i}, {j}) & {_LANES}L) * ww + (shiftrightunsigned(g{i}, {j}) & {_LANES}L) * pw)")
    summed = hashed.groupBy(*keys).agg(F.sum(F.col("ww") + F.col("pw")).alias("total"), *[vote(i, j).alias(f"v{i}_{j}") for i in range(2) for j in range(32)])
    sign = "CASE WHEN 2 * (x & 4294967295L) > total THEN shiftleft(1L, i) ELSE 0L END + CASE WHEN 2 * shiftrightunsigned(x, 32) > total THEN shiftleft(1L, i + 32) ELSE 0L END"
    bits = [F.expr(f"aggregate(transform(array({', '.join(f'v{i}_{j}' for j in range(32))}), (x, i) -> {sign}), 0L, (s, x) -> s | x)").alias(f"f{i}") for i in range(2)]
    return summed.select(*keys, *bits)


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """The share of equal bits."""
    apart = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True)), F.lit(0))
    return 1.0 - apart / float(BITS)


def shown(f0: str, f1: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f0), 16, "0")))


def _masks(blocks: int) -> list[tuple[int, int]]:
    """The bits of each block, as signed longs of either half."""
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    spans = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [(signed(s & (1 << 64) - 1), signed(s >> 64)) for s in spans]


def neighbours(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """prints (f0, f1, n), distinct fingerprints and their documents -> (f0, f1, near): the documents of other fingerprints within
    ``radius`` bits; only fingerprints that share a bucket with another are in the result."""
    if not 0 <= radius < blocks:
        raise ValueError("blocks must be more than the radius")
    masks = _masks(blocks)
    tables = [(sum(masks[b][0] for b in chosen), sum(masks[b][1] for b in chosen)) for chosen in combinations(range(blocks), blocks - radius)]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("f0").bitwiseAND(F.lit(a)).alias("k0"), F.col("f1").bitwiseAND(F.lit(b)).alias("k1")) for t, (a, b) in enumerate(tables)])
    bucket = ["t", "k0", "k1"]
    listed = prints.select("f0", "f1", "n", F.inline(keys))
    sizes = listed.groupBy(*bucket).agg(F.ceil(F.count("*") / PART).alias("parts"), F.count("*").alias("c")).where("c > 1").drop("c")
    placed = listed.join(sizes, bucket).withColumn("part", F.pmod(F.xxhash64("f0", "f1"), F.col("parts")))
    packs = placed.groupBy(*bucket, "parts", "part").agg(F.collect_list(F.struct("f0", "f1", "n")).alias("m"))
    alone = packs.where("parts = 1").select("t", "m", F.col("m").alias("o"))
    many = packs.where("parts > 1")
    left = many.select(*bucket, "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    met = left.join(many.select(*bucket, "part", F.col("m").alias("o")), [*bucket, "part"]).select("t", "m", "o")
    near = f"bit_count(x.f0 ^ y.f0) + bit_count(x.f1 ^ y.f1) BETWEEN 1 AND {radius}"
    first = "".join(f" AND NOT (t > {t} AND ((x.f0 ^ y.f0) & {a}L) = 0 AND ((x.f1 ^ y.f1) & {b}L) = 0)" for t, (a, b) in enumerate(tables[:-1]))
    counted = f"inline(transform(m, x -> struct(x.f0 AS f0, x.f1 AS f1, aggregate(filter(o, y -> {near}{first}), 0L, (s, y) -> s + y.n) AS near)))"
    return alone.unionByName(met).select(F.expr(counted)).where("near > 0").groupBy("f0", "f1").agg(F.sum("near").alias("near"))


def _bounds(docs: DataFrame, cells: int) -> list[int]:
    """Approximate percentiles of doc_id, ascending."""
    found = docs.agg(F.percentile_approx("doc_id", [k / cells for k in range(1, cells)], 10_000)).first()[0] if cells > 1 else []
    return sorted({x for x in found or [] if x is not None})


def _cell(bounds: list[int]) -> Column:
    """2 k + 1 for the k-th bound itself, 2 k for ids between bounds, after all the rest for null; looked for in two steps."""
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    whole = F.array(*[F.lit(g[-1]).cast("long") for g in groups]) if groups else F.array().cast("array<long>")
    inner = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups], F.array().cast("array<long>"))
    skipped = F.size(F.filter(whole, lambda b: b < F.col("doc_id")))
    group = F.element_at(inner, skipped + 1)
    less = F.least(skipped * step, F.lit(len(bounds))) + F.size(F.filter(group, lambda b: b < F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), 2 * len(bounds) + 2).otherwise(2 * less + F.exists(group, lambda b: b == F.col("doc_id")).cast("int"))


def edited(docs: DataFrame) -> DataFrame:
    """(row, next, doc_id, text, edited, n_chars): row numbers the documents, next is the row of the next document."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = _bounds(ids.select("doc_id"), min(MOST_CELLS, CELLS * shuffle_partitions(docs.sparkSession)))
    sub = F.when(F.col("cell") % 2 == 1, F.shiftrightunsigned("text_hash", 56)).when(F.col("cell") > 2 * len(bounds), F.shiftrightunsigned("text_hash", 56)).otherwise(0)
    celled = ids.withColumn("cell", _cell(bounds)).withColumn("text_hash", F.xxhash64("text")).withColumn("cell", F.col("cell").cast("long") * SUBS + sub.cast("long"))
    rank = F.shiftrightunsigned("text_hash", 1)
    order = W.partitionBy("cell").orderBy("doc_id", rank, "text_hash")
    rowed = celled.select("cell", "doc_id", "text", F.row_number().over(order).alias("k"), F.lead("text").over(order).alias("after"))
    heads = rowed.where("k = 1").select("cell", F.col("text").alias("head"))
    # One row for each cell goes to this task: at most MOST_CELLS and those of ids with cells of their own.
    every = W.orderBy("cell")
    follow = celled.select("cell").distinct().select("cell", F.coalesce(F.lead("cell").over(every), F.min("cell").over(W.partitionBy())).alias("follow"))
    heads = follow.join(heads.withColumnRenamed("cell", "follow"), "follow").select("cell", "follow", "head")
    n, last = F.char_length("text"), F.col("after").isNull()
    taken = F.floor(n / 4).cast("int")
    number = lambda cell, k: F.shiftleft(cell, 40) + k
    return rowed.join(heads, "cell").select(
        number(F.col("cell"), F.col("k")).alias("row"),
        F.when(last, number(F.col("follow"), F.lit(1))).otherwise(number(F.col("cell"), F.col("k") + 1)).alias("next"),
        "doc_id", "text", F.concat(F.substring("text", F.lit(1), n - taken), F.substring(F.coalesce("after", "head"), F.lit(1), taken)).alias("edited"), n.cast("long").alias("n_chars"),
    )


def compared(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near) for each row of docs; n_near:
    how many other documents have a fingerprint within the radius."""
    about = ["row", "next", "doc_id", "n_chars", "edited_sha256"]
    both = edited(docs).select("row", "next", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("which", "text"))
    one = fingerprints(both, "text", [*about, "which"])
    of = lambda which, f: F.max(F.when(F.col("which") == which, F.col(f)))
    made = written(one.groupBy(*about).agg(of(0, "f0").alias("f0"), of(0, "f1").alias("f1"), of(1, "f0").alias("e0"), of(1, "f1").alias("e1")), "simhash")
    prints = made.groupBy("f0", "f1").agg(F.count("*").alias("n"))
    near = written(prints.join(neighbours(prints, radius, blocks), ["f0", "f1"], "left").select("f0", "f1", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_near")), "simhash-near")
    after = made.select(F.col("row").alias("next"), F.col("f0").alias("a0"), F.col("f1").alias("a1"))
    return made.join(after, "next").join(near, ["f0", "f1"]).select(
        "doc_id", "n_chars", "edited_sha256", shown("f0", "f1").alias("fingerprint"), shown("e0", "e1").alias("edited_fingerprint"),
        likeness(("f0", "f1"), ("e0", "e1")).alias("near_edited"), likeness(("f0", "f1"), ("a0", "a1")).alias("near_next"), "n_near",
    )


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(documents(spark, sf_dir))
