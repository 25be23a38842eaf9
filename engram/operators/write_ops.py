"""Which write each new fact asks for, decided against a frozen bank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions.json_fields import parse_decision
from engram.functions.rules import note_fields, summary
from engram.functions.text import is_query
from engram.operators import bank
from engram.operators.construct import build_notes
from engram.schema import Params


def decide(facts: DataFrame, bank_keywords: DataFrame) -> DataFrame:
    """facts (fact_id, content) against bank_keywords (id, write_seq, keyword): (fact_id, op, target_id).

    A query is NOOP; a fact that shares a keyword, in any case, with the bank updates the note written first of those; any other
    is ADD. The bank is reduced to its first note of each keyword before the join, so a common keyword makes no pairs."""
    first = bank_keywords.groupBy(F.lower("keyword").alias("keyword")).agg(F.min(F.struct("write_seq", "id")).alias("first"))
    own = facts.select("fact_id", is_query(F.col("content")).alias("query"), F.explode(note_fields(F.col("content"))["keywords"]).alias("keyword"))
    own = own.select("fact_id", "query", F.lower("keyword").alias("keyword"))
    best = own.join(first, "keyword", "left").groupBy("fact_id").agg(F.first("query").alias("query"), F.min("first").alias("first"))
    return best.select(
        "fact_id",
        F.when(F.col("query"), "NOOP").when(F.col("first").isNotNull(), "UPDATE").otherwise("ADD").alias("op"),
        F.when(~F.col("query"), F.col("first")["id"]).alias("target_id"),
    )


def fallback(facts: DataFrame, notes: DataFrame) -> DataFrame:
    """The decision where a reply could not be read: ADD to an empty bank, else UPDATE of its first note."""
    oldest = notes.groupBy("bank_id").agg(F.min_by("id", "write_seq").alias("target_id"))
    joined = facts.join(oldest, "bank_id", "left")
    return joined.select("bank_id", "fact_id", F.when(F.col("target_id").isNull(), "ADD").otherwise("UPDATE").alias("op"), "target_id")


def select_op(facts: DataFrame, notes: DataFrame) -> DataFrame:
    """facts (bank_id, reply, ...) with op and target_id in the place of reply: what the reply says, its target null where the
    bank has no such note, and the fallback where no operation can be read from it."""
    oldest = notes.groupBy("bank_id").agg(F.min_by("id", "write_seq").alias("_oldest"))
    known = notes.select("bank_id", F.col("id").alias("_asked"), F.lit(True).alias("_known"))
    read = facts.withColumn("_d", parse_decision(F.col("reply"))).withColumn("_asked", F.col("_d.target_id"))
    joined = read.join(oldest, "bank_id", "left").join(known, ["bank_id", "_asked"], "left")
    unread = F.col("_d.op").isNull()
    op = F.when(~unread, F.col("_d.op")).when(F.col("_oldest").isNull(), "ADD").otherwise("UPDATE")
    target = F.when(unread, F.col("_oldest")).when(F.col("_known"), F.col("_asked"))
    kept = [F.col(c) for c in facts.columns if c != "reply"]
    return joined.select(*kept, op.alias("op"), target.alias("target_id"))


def apply_writes(notes: DataFrame, writes: DataFrame) -> DataFrame:
    """The table after writes (a note's columns, op, target_id), decided against it as it was; write_seq is above the table's.

    ADD writes the note, UPDATE writes it over its target (links and utility stay the target's; without a target it is a note of
    its own), DELETE removes the target, NOOP and a DELETE without a target do nothing. Of several writes to one note the
    last counts."""
    target = F.when(F.col("op") == "UPDATE", F.col("target_id"))
    put = bank.merge_update(notes, writes.where("op IN ('ADD', 'UPDATE')").withColumn("target_id", target).drop("op"))
    gone = writes.where("op = 'DELETE' AND target_id IS NOT NULL").select("bank_id", F.col("target_id").alias("id"), "write_seq", F.lit(True).alias("_gone"))
    last = bank._last(put.withColumn("_gone", F.lit(False)).unionByName(gone, allowMissingColumns=True))
    kept = notes.join(last.select("bank_id", "id"), ["bank_id", "id"], "left_anti")
    return kept.unionByName(last.where(~F.col("_gone")).select(*notes.columns))


def write_path(notes: DataFrame, facts: DataFrame) -> DataFrame:
    """notes after facts (a note's columns, and the model's reply on each): decide, then apply."""
    return apply_writes(notes, select_op(facts, notes))


def consolidate(answered: DataFrame, p: Params = Params()) -> DataFrame:
    """The notes to add for answered (bank_id, id, query, answer, reward, ts, write_seq): the summary of each rewarded turn, built
    as a note is. A turn without query, answer or reward leaves none."""
    whole = answered.where("query IS NOT NULL AND answer IS NOT NULL AND reward IS NOT NULL")
    content = summary(F.col("query"), F.col("answer"), F.col("reward").cast("double"))
    return build_notes(whole.select("bank_id", "id", content.alias("content"), "ts", "write_seq"), p)
