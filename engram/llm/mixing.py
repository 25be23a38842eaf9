"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1 ... and share all words; a target stops at
MAX_PASSES times its source's size and its excess is reshared by weight, which is filling up to a common level.
Golden-ratio points frac(i * phi), in exact 53-bit arithmetic, are mapped through the cumulative quotas (targets in whole
words) and give slot i its source. The slots of a source are ranked; its r-th slot takes block r of BLOCK words of the source's
endless stream: its documents in the order of a hash, again and again. The last block of a source is cut at the
target. A source that the finite sequence left short gets its missing slots at the end of the schedule.

So the quotas say what is taken, and the schedule in which order: ``blocks`` gives the pieces of each slot, ``taken`` the first slot
of each document, and ``mix`` deals documents out in slot order, so that any stretch of the mix has the sources near their
shares.

Ranks and running sums of a source are taken in two steps, within hash ranges and over the ranges' sums, so
no task sees a whole source, however large. Only the table of sources, a row for each, is ordered in one task.

Null and odd input: a null or blank text has size 0 and is never taken; a null source is a source; a null doc_id is
a document. Repeated rows (same doc_id, source and size) each have a place of their own in the stream; which of them is
which does not show. An empty table gives an empty result. Clashing names: only doc_id, source and text are
read, all else is carried by ``mix`` alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.llm.common import WORD, documents, integer_ids, n_words, shuffle_partitions, written

BLOCK = 4096
MAX_PASSES = 3
WEIGHTS = (5, 2, 1)
#: Bits of a point, and the golden ratio's inverse in as many.
BITS = 53
GOLDEN = (math.isqrt(5 << 2 * BITS) - (1 << BITS)) // 2
#: Hash ranges of a source's stream, slots of a rank's range, cells of the cumulative weights.
RANGES, SLOT_RANGE, CELLS = 4096, 65536, 1024


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, text_hash, shuffle_key): all that the schedule needs, without the texts."""
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("mix"))), 1, 15), 16, 10)
    return integer_ids(docs.select("doc_id", "source", n_words().alias("size"), F.xxhash64("text").alias("text_hash")), "doc_id").withColumn(
        "shuffle_key", F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    )


def targets(sized: DataFrame) -> DataFrame:
    """(source, place, source_size, weight, target, quota): one row for each source; place: its number in the order."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS)) + 1)
    ranked = by_source.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * MAX_PASSES)
    # Capped sources are those with the least cap per weight: find the level at which the rest shares what is left.
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    after = fill.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = ranked.withColumn("level", level)
    free = levels.withColumn("free", F.col("level") <= F.col("cap") / F.col("weight"))
    final = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("level")))).over(every)["level"]
    target = F.least(F.col("cap"), F.coalesce(final, F.lit(float("inf"))) * F.col("weight"))
    return free.select("source", "place", "source_size", "weight", target.alias("target")).withColumn(
        "quota", F.least(F.round("target").cast("long"), F.col("source_size") * MAX_PASSES)
    )


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def point(slot: Column) -> Column:
    """frac(slot * phi) for any slot number that a long holds."""
    whole, bits = F.lit(1 << BITS).cast("decimal(16,0)"), F.lit(GOLDEN).cast("decimal(16,0)")
    return (slot.cast("decimal(20,0)") * bits % whole).cast("double") / float(1 << BITS)


def slots(goal: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source, r): the schedule; r counts the slots of a source from 0 up to its quota."""
    spark = goal.sparkSession
    upto, total = W.orderBy("place").rowsBetween(W.unboundedPreceding, 0), F.sum("quota").over(W.partitionBy())
    shares = goal.withColumn("upto", F.sum("quota").over(upto)).withColumn("hi", F.col("upto") / total).withColumn("lo", (F.col("upto") - F.col("quota")) / total)
    shares = shares.withColumn("need", F.ceil(F.col("quota") / block)).where("need > 0")
    cells = shares.select(
        F.col("source").alias("s_source"), "lo", "hi", "need",
        F.explode(F.sequence(F.floor(F.greatest(F.col("lo"), F.lit(0.0)) * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"),
    )
    # Two numbers go to the driver: how many slots and sources there are.
    n, places = goal.agg(F.coalesce(F.sum(F.ceil(F.col("quota") / block)), F.lit(0)).cast("long"), F.count("*")).first()
    points = spark.range(n).select(F.col("id").alias("slot"), point(F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    hit = points.join(cells, "cell").where("u >= lo AND u < hi").select("slot", F.col("s_source").alias("source"), F.floor(F.col("slot") / SLOT_RANGE).alias("range"))
    in_range = hit.withColumn("k", F.row_number().over(W.partitionBy("source", "range").orderBy("slot")) - 1)
    counts = hit.groupBy("source", "range").agg(F.count("*").alias("c"))
    earlier = F.coalesce(F.sum("c").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("source").alias("c_source"), F.col("range").alias("c_range"), earlier.alias("earlier"))
    ranked = in_range.join(counts, _same(F.col("source"), F.col("c_source")) & (F.col("range") == F.col("c_range"))).select("slot", "source", (F.col("earlier") + F.col("k")).alias("r"))
    need = shares.select(F.col("source").alias("n_source"), "place", "need")
    used = ranked.join(need, _same(F.col("source"), F.col("n_source"))).where("r < need").select("slot", "source", "r")
    got = hit.groupBy("source").agg(F.count("*").alias("got")).withColumnRenamed("source", "g_source")
    short = need.join(got, _same(F.col("n_source"), F.col("g_source")), "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    late = short.select(F.col("n_source").alias("source"), "place", F.explode(F.sequence("got", F.col("need") - 1)).alias("r"))
    return used.unionByName(late.select((F.lit(n) + F.col("r") * places + F.col("place")).alias("slot"), "source", "r"))


def stream(sized: DataFrame) -> DataFrame:
    """sized with start: the words of its source's documents before it in shuffled order."""
    ranged = sized.withColumn("range", F.shiftright("shuffle_key", 48).cast("int"))  # 60-bit keys, RANGES of them
    order = W.partitionBy("source", "range").orderBy("shuffle_key", "doc_id", "size", "text_hash").rowsBetween(W.unboundedPreceding, -1)
    inner = ranged.withColumn("inner", F.coalesce(F.sum("size").over(order), F.lit(0)))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(F.col("source").alias("b_source"), F.col("range").alias("b_range"), F.coalesce(before, F.lit(0)).alias("before"))
    return inner.join(sums, _same(F.col("source"), F.col("b_source")) & (F.col("range") == F.col("b_range"))).select(
        "doc_id", "source", "size", "text_hash", "shuffle_key", (F.col("before") + F.col("inner")).alias("start")
    )


def pieces(placed: DataFrame, goal: DataFrame, schedule: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row_id, slot, pass, first, words): the words [first, first + words) of a document that a slot takes."""
    g = goal.where("quota > 0").select(F.col("source").alias("t_source"), "source_size", "quota")
    passes = placed.where("size > 0").join(g, _same(F.col("source"), F.col("t_source")))
    passes = passes.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MAX_PASSES - 1))))
    passes = passes.withColumn("lo", F.col("start") + F.col("pass") * F.col("source_size"))
    passes = passes.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("quota"))).where("hi > lo")
    cut = passes.withColumn("r", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    a, b = F.greatest(F.col("lo"), F.col("r") * block), F.least(F.col("hi"), (F.col("r") + 1) * block)
    cut = cut.select("row_id", "source", "pass", "r", (a - F.col("lo")).alias("first"), (b - a).alias("words"))
    s = schedule.select("slot", F.col("source").alias("l_source"), F.col("r").alias("l_r"))
    return cut.join(s, _same(F.col("source"), F.col("l_source")) & (F.col("r") == F.col("l_r"))).select("row_id", "slot", "pass", "first", "words")


def plan(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed, goal, pieces); placed has a row_id for each row."""
    sized = written(sizes(docs), "sizes")
    goal = written(targets(sized), "targets")
    placed = written(stream(sized).withColumn("row_id", F.monotonically_increasing_id()), "stream")
    return placed, goal, pieces(placed, goal, slots(goal, block), block)


def taken(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot) for each row of docs; first_slot: where the mix first takes it, or -1."""
    placed, goal, parts = plan(docs, block)
    words = parts.groupBy("row_id").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    g = goal.select(F.col("source").alias("t_source"), "source_size", "target")
    return placed.join(words, "row_id", "left").join(g, _same(F.col("source"), F.col("t_source"))).select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("first_slot", F.lit(-1)).alias("first_slot")
    )


def blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source, doc_id, pass, first, words): the mix in slots; a slot has ``block`` words of one source, the last of a source
    fewer."""
    placed, _, parts = plan(docs, block)
    return parts.join(placed.select("row_id", "doc_id", "source"), "row_id").select("slot", "source", "doc_id", "pass", "first", "words")


_KEY = ("doc_id", "source", "size", "text_hash")


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix in slot order: each row of docs once for each time that it is taken, the last time of a source's share cut. All columns
    stay; n_chars, if there, follows a cut text. Partitions are consecutive stretches of the schedule."""
    placed, _, parts = plan(docs, block)
    copy = F.row_number().over(W.partitionBy(*_KEY).orderBy("start"))
    passes = parts.groupBy("row_id", "pass").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    numbered = placed.withColumn("copy", copy)
    takes = written(numbered.join(passes, "row_id").select(*[F.col(c).alias(f"k_{c}") for c in _KEY], F.col("copy").alias("k_copy"), "words", "slot"), "takes")
    again = written(numbered.where("copy > 1").groupBy(*_KEY).count().select(*[F.col(c).alias(f"a_{c}") for c in _KEY]), "again")
    own = [F.col("doc_id").cast("long").alias("_doc_id"), F.col("source").alias("_source"), n_words().alias("_size"), F.xxhash64("text").alias("_text_hash")]
    left = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), *own).withColumn("_copy", F.lit(1))
    if again.limit(1).count():  # rows that are alike are told apart by a number
        alike = [_same(left[f"_{c}"], again[f"a_{c}"]) for c in _KEY]
        several = left.join(again, alike, "left_semi").withColumn("_copy", F.row_number().over(W.partitionBy(*[f"_{c}" for c in _KEY]).orderBy("_size")))
        left = left.join(again, alike, "left_anti").unionByName(several)
    rows = left.join(takes, [*[_same(F.col(f"_{c}"), F.col(f"k_{c}")) for c in _KEY], F.col("_copy") == F.col("k_copy")])
    last, n = takes.agg(F.max("slot")).first()[0] or 0, shuffle_partitions(docs.sparkSession)
    dealt = rows.repartitionById(n, F.floor(F.col("slot") / (last + 1) * n).cast("int")).sortWithinPartitions("slot", "_text_hash")
    cut, whole = F.array_join(F.slice(F.regexp_extract_all("_row.text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " "), F.col("words") == F.col("_size")
    changed = {"text": F.when(whole, F.col("_row.text")).otherwise(cut)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(whole, F.col("_row.n_chars")).otherwise(F.char_length(cut)).cast(docs.schema["n_chars"].dataType)
    return dealt.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(documents(spark, sf_dir))


OP7_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR || ':mix'), 1, 15))::BIGINT AS shuffle_key FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed_sources AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM by_source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(place % 3 + 1)::INT] AS weight, source_size * 3.0::DOUBLE AS cap FROM placed_sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)),
level AS (SELECT arg_min(level, cap / weight) AS level FROM levels WHERE level <= cap / weight),
goal AS (SELECT source, place, source_size, least(cap, (SELECT level FROM level) * weight) AS target FROM weighed),
quotas AS (SELECT *, least(round(target)::BIGINT, 3 * source_size) AS quota FROM goal),
shares AS (
  SELECT source, place, (quota + {BLOCK - 1}) // {BLOCK} AS need, sum(quota) OVER (ORDER BY place)::DOUBLE / sum(quota) OVER () AS hi,
         (sum(quota) OVER (ORDER BY place) - quota)::DOUBLE / sum(quota) OVER () AS lo FROM quotas),
many AS (SELECT sum(need)::BIGINT AS n, count(*) AS places FROM shares),
points AS (
  SELECT slot, ((slot::HUGEINT * {GOLDEN}) % {1 << BITS})::DOUBLE / {float(1 << BITS)}::DOUBLE AS u
  FROM (SELECT unnest(range(n)) AS slot FROM many)),
hit AS (SELECT slot, place, need, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS r FROM points JOIN shares ON u >= lo AND u < hi),
got AS (SELECT s.place, s.need, count(h.slot) AS c FROM shares s LEFT JOIN hit h ON s.place = h.place GROUP BY ALL),
late AS (SELECT place, unnest(range(c, need)) AS r FROM got WHERE c < need),
slots AS (
  SELECT slot, place, r FROM hit WHERE r < need
  UNION ALL SELECT n + r * places + place, place, r FROM late, many),
placed AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY shuffle_key, doc_id, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sized)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size = 0 THEN 0 ELSE (quota // source_size) * size
    + least(greatest(quota % source_size - start, 0), size) END)::BIGINT AS taken, coalesce(slot, -1)::BIGINT AS first_slot
FROM placed JOIN quotas ON placed.source IS NOT DISTINCT FROM quotas.source
LEFT JOIN slots ON slots.place = quotas.place AND slots.r = start // {BLOCK} AND size > 0 AND start < quota
"""
