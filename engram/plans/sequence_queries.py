"""Writes in order, bank by bank, held against a recursive fold in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import sequential
from engram.plans.registry import query, table
from engram.plans.text_queries import QUESTION_SQL
from engram.plans.vector_queries import FIELDS_SQL

#: Documents as facts of their source's bank, in the order of doc_id; every fifth stands in the table before the first write.
ORDER_SQL = f"""{FIELDS_SQL},
told AS (SELECT coalesce(source, '') AS bank, f.doc_id, list_transform(keywords, lambda x: lower(x)) AS k, {QUESTION_SQL.format("f.text")} AS asks, md5(f.text) AS content
  FROM fields f JOIN documents d ON d.doc_id = f.doc_id),
held AS (SELECT bank, list({{'root': doc_id::VARCHAR, 'at': doc_id - 1000000000000, 'k': k, 'content': content, 'q': 0.25}} ORDER BY doc_id) AS live FROM told WHERE doc_id % 5 = 0 GROUP BY bank),
facts AS (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY doc_id) AS i FROM told WHERE doc_id % 5 <> 0),
fold AS (
  SELECT b.bank, 0::BIGINT AS i, coalesce(live, []) AS live, NULL::BIGINT AS doc_id, NULL::VARCHAR AS op, NULL::VARCHAR AS note
  FROM (SELECT DISTINCT bank FROM told) b LEFT JOIN held h ON h.bank = b.bank
  UNION ALL
  SELECT bank, i, CASE WHEN asks THEN live ELSE list_append(CASE WHEN hit IS NULL THEN live ELSE list_concat(live[1:hit - 1], live[hit + 1:]) END,
    {{'root': CASE WHEN hit IS NULL THEN doc_id::VARCHAR ELSE live[hit].root END, 'at': doc_id, 'k': k, 'content': content, 'q': CASE WHEN hit IS NULL THEN 0.5 ELSE live[hit].q END}}) END,
    doc_id, CASE WHEN asks THEN 'NOOP' WHEN hit IS NULL THEN 'ADD' ELSE 'UPDATE' END, CASE WHEN asks THEN NULL WHEN hit IS NULL THEN doc_id::VARCHAR ELSE live[hit].root END
  FROM (SELECT f.*, o.live, nullif(list_position(list_transform(o.live, lambda x: list_has_any(x.k, f.k)), true), 0) AS hit
    FROM fold o JOIN facts f ON f.bank = o.bank AND f.i = o.i + 1))"""


def _told(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("bank_id"), F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("seq"), F.col("text").alias("content"))
    told = sequential.facts_of(docs).withColumn("links", F.array().cast("array<string>"))
    notes = told.where("seq % 5 = 0").select("bank_id", "id", "content", "keywords", "links", F.lit(0.25).alias("utility"), (F.col("seq") - 10**12).alias("write_seq"))
    return notes, told.where("seq % 5 <> 0").withColumn("utility", F.lit(0.5)).withColumn("write_seq", F.lit(None).cast("long"))


@query(f"WITH RECURSIVE {ORDER_SQL} SELECT bank AS bank_id, doc_id::VARCHAR AS id, op, note AS note_id FROM fold WHERE i > 0")
def sequential_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document does to its source's bank, one after another: a source may hold most documents."""
    return sequential.decide_in_order(*_told(spark, sf_dir)).select("bank_id", "id", "op", "note_id")


@query(f"""WITH RECURSIVE {ORDER_SQL}, ends AS (SELECT bank, unnest(live) AS n FROM (SELECT bank, live FROM fold QUALIFY row_number() OVER (PARTITION BY bank ORDER BY i DESC) = 1))
SELECT bank AS bank_id, n.root AS id, n.content AS content, n.q::DOUBLE AS utility, row_number() OVER (PARTITION BY bank ORDER BY n."at") AS place FROM ends""")
def sequential_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The banks after all writes, in scan order."""
    from pyspark.sql import Window as W

    after = sequential.write_in_order(*_told(spark, sf_dir))
    return after.select("bank_id", "id", F.md5("content").alias("content"), "utility", F.row_number().over(W.partitionBy("bank_id").orderBy("write_seq")).alias("place"))


@query(f"""WITH RECURSIVE {FIELDS_SQL.replace("documents", "(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)")},
facts AS (SELECT doc_id // 1000 AS bank, doc_id, keywords AS k, {QUESTION_SQL.format("text")} AS asks, row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id) AS i FROM fields),
fold AS (
  SELECT DISTINCT bank, 0::BIGINT AS i, []::STRUCT(root BIGINT, k VARCHAR[])[] AS live, NULL::BIGINT AS doc_id, NULL::VARCHAR AS op, NULL::BIGINT AS note FROM facts
  UNION ALL
  SELECT bank, i, CASE WHEN asks THEN live ELSE list_append(CASE WHEN hit IS NULL THEN live ELSE list_concat(live[1:hit - 1], live[hit + 1:]) END, {{'root': CASE WHEN hit IS NULL THEN doc_id ELSE live[hit].root END, 'k': k}}) END,
    doc_id, CASE WHEN asks THEN 'NOOP' WHEN hit IS NULL THEN 'ADD' ELSE 'UPDATE' END, CASE WHEN asks THEN NULL WHEN hit IS NULL THEN doc_id ELSE live[hit].root END
  FROM (SELECT f.*, o.live, nullif(list_position(list_transform(o.live, lambda x: list_has_any(x.k, f.k)), true), 0) AS hit
    FROM fold o JOIN facts f ON f.bank = o.bank AND f.i = o.i + 1))
SELECT bank AS conv_id, (doc_id % 1000)::BIGINT AS turn, op, (note % 1000)::VARCHAR AS note FROM fold WHERE i > 0""")
def sequential_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation written turn by turn into an empty bank of its own."""
    c = table(spark, sf_dir, "conversations")
    facts = sequential.facts_of(c.select(F.col("conv_id").alias("bank_id"), F.col("turn").cast("string").alias("id"), F.col("turn").alias("seq"), F.col("text").alias("content")))
    none = facts.where("false").select("bank_id", "id", "keywords", F.col("seq").alias("write_seq"))
    return sequential.decide_in_order(none, facts).select(F.col("bank_id").alias("conv_id"), F.col("seq").alias("turn"), "op", F.col("note_id").alias("note"))
