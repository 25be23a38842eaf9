"""The data side of training an answering model: prompts from triples, and rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.operators.evaluation import exact
from engram.sources.files import filled

#: Fixed value: the prompt's wording.
PROMPT = (
    "You are an answer agent. Given a query and candidate notes, select the minimal subset needed and answer accurately.\n\n"
    "Query: {query}\nCandidates: {candidates}\n\n"
    "Return ONLY JSON with keys: selected_ids (list of ids), answer (string)."
)


def prompts(triples: DataFrame) -> DataFrame:
    """triples (query, candidates array of structs, gold_answer) with the column prompt."""
    return triples.withColumn("prompt", filled(PROMPT, query=F.col("query"), candidates=F.to_json("candidates")))


def reward(completion: Column, gold: Column) -> Column:
    """1 for an answer equal up to case and blanks, else 0."""
    return exact(completion, gold)
