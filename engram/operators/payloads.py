"""What a model is shown of notes, and which notes a filter of their attributes leaves."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.rules import lowered
from engram.sources.files import filled

SHORT = ("id", "keywords", "tags", "description")
LONG = (*SHORT, "content", "utility")


def payload(columns: tuple[str, ...] = SHORT) -> Column:
    """A note as a JSON object: SHORT where writes and links are decided, LONG where an answer is."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def listed(candidates: DataFrame, by: str, item: Column, between: str) -> DataFrame:
    """(by, text): the items of each key in the order of rank. Candidates are the few rows that retrieval left of a key."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("rank"), item.alias("item"))))
    return candidates.groupBy(by).agg(F.array_join(F.transform(rows, lambda r: r["item"]), between).alias("text"))


def answer_prompts(queries: DataFrame, candidates: DataFrame, template: str) -> DataFrame:
    """queries (query_id, query) and candidates (query_id, rank, a note's columns) -> (query_id, prompt): the notes as a JSON list,
    empty where there is none."""
    notes = listed(candidates, "query_id", payload(LONG), ",")
    shown = F.concat(F.lit("["), F.coalesce("text", F.lit("")), F.lit("]"))
    return queries.join(notes, "query_id", "left").select("query_id", filled(template, query=F.col("query"), notes=shown).alias("prompt"))


def baseline_prompts(queries: DataFrame, candidates: DataFrame, template: str) -> DataFrame:
    """The same with the notes' contents as bullets, for the answer without a reply that could be read."""
    bullets = listed(candidates, "query_id", F.concat(F.lit("- "), F.coalesce("content", F.lit(""))), "\n")
    return queries.join(bullets, "query_id", "left").select("query_id", filled(template, query=F.col("query"), context=F.coalesce("text", F.lit(""))).alias("prompt"))


def matching(notes: DataFrame, keywords: Iterable[str] = (), tags: Iterable[str] = ()) -> DataFrame:
    """Notes with one of the keywords and one of the tags, in any case; of what is not asked for, any."""
    out = notes
    for column, asked in (("keywords", keywords), ("tags", tags)):
        if words := [F.lower(F.lit(w)) for w in asked]:
            out = out.where(F.arrays_overlap(lowered(F.col(column)), F.array(*words)))
    return out


def with_ids(facts: DataFrame) -> DataFrame:
    """facts (bank_id, content, ts, write_seq) with id: a hash of the four, so a task that runs again gives the same ids."""
    key = F.to_json(F.struct("bank_id", "ts", "content", "write_seq"), {"ignoreNullFields": "false"})
    return facts.withColumn("id", F.sha2(key, 256))
