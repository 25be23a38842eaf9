"""python -m engram: a short demonstration on local Spark, facts first, then questions."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from engram.functions.text import is_query
from engram.operators.replay import replay
from engram.schema import Params

#: The demonstration's facts and questions.
FACTS = ["My name is Alex.", "I adopted a dog named Buddy.", "I also adopted another dog named Scout.", "I work as a data scientist at a tech company."]
QUESTIONS = ["What dogs do I have?", "What is my job?", "What is my name?"]


def main() -> None:
    from pyspark.sql import functions as F

    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("lines", nargs="*", help="facts and questions in order; the demonstration's without any")
    p.add_argument("--reward", type=float, default=0.8)
    p.add_argument("--delta", type=float, default=0.1)
    args = p.parse_args()
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
    lines = spark.createDataFrame(list(enumerate(args.lines or FACTS + QUESTIONS)), "turn long, text string")
    asks = is_query(F.col("text"))
    turns = lines.select(
        F.lit("demo").alias("bank_id"), "turn", F.when(~asks, F.col("text")).alias("content"), F.when(asks, F.col("text")).alias("query"), F.when(asks, args.reward).alias("reward")
    )
    for r in replay(turns, Params(delta=args.delta)).orderBy("turn").collect():
        print(f"[{r['turn']}] {r['op']} {r['note_id']}" if r["query"] is None else f"[{r['turn']}] {r['query']} -> {r['answer']} (from {', '.join(r['used'])})")
    spark.stop()


if __name__ == "__main__":
    main()
