"""Replies of a model, asked for once and kept: what was answered is in a table, so a run that broke off goes on where it stopped.

Prompts are told apart by a hash of their text. Those without a kept reply are asked in ``rounds`` parts, each of which is added to the table as it is
done; a call that fails costs its own prompts alone, as the task notes the error and goes on. Null prompts have null replies
and are not asked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Generates replies to a list of prompts, in their order.
Generate = Callable[[list[str]], list[str]]
KEPT = "key string, prompt string, reply string, error string"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def key_of(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def kept(spark: SparkSession, path: str) -> DataFrame:
    """(key, reply) of every prompt that has been answered, once each."""
    rows = spark.read.schema(KEPT).parquet(path) if _exists(spark, path) else spark.createDataFrame([], KEPT)
    return rows.where("error IS NULL").groupBy("key").agg(F.max("reply").alias("reply"))


def ask(prompts: DataFrame, load: Callable[[], Generate], path: str, rounds: int = 1, at_once: int = 64, strict: bool = True) -> DataFrame:
    """prompts with a column reply, of their column prompt; load gives the generator, once a task. Replies are kept under ``path``. If some calls failed, what
    could be answered is kept first; then strict raises, and otherwise their replies are null. A further call asks them again."""
    spark = prompts.sparkSession

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = load()
        for frame in frames:
            for at in range(0, len(frame), at_once):
                part = frame.iloc[at : at + at_once]
                texts = part["prompt"].tolist()
                try:
                    said, error = list(generate(texts)), None
                    if len(said) != len(texts):
                        said, error = [None] * len(texts), f"{len(said)} replies to {len(texts)} prompts"
                except Exception as e:  # whatever a generator may raise
                    said, error = [None] * len(texts), repr(e)[:500]
                yield pd.DataFrame({"key": part["key"].tolist(), "prompt": texts, "reply": said, "error": [error] * len(texts)}, dtype=object)

    distinct = prompts.where("prompt IS NOT NULL").select(key_of(F.col("prompt")).alias("key"), "prompt").dropDuplicates(["key"])
    part = F.pmod(F.xxhash64("key"), F.lit(rounds))
    for k in range(rounds):
        todo = distinct.where(part == k).join(kept(spark, path).select("key"), "key", "left_anti")
        todo.mapInPandas(run, KEPT).write.mode("append").parquet(path)
    answered = kept(spark, path)
    if strict:
        failed = distinct.join(answered, "key", "left_anti").count()
        if failed:
            why = spark.read.schema(KEPT).parquet(path).where("error IS NOT NULL").select("error").first()
            raise RuntimeError(f"{failed} prompts have no reply: {why[0] if why else ''}")
    return prompts.withColumn("_key", key_of(F.col("prompt"))).join(answered.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")
