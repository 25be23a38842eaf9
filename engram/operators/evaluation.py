"""Scores of predictions, result tables and annotation sets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.text import normalized
from engram.functions.vector import lcs_f
from engram.operators.token_match import token_match

METRICS = ("em", "rougeL", "bertscore_f1")


def exact(prediction: Column, reference: Column) -> Column:
    return (normalized(prediction) == normalized(reference)).cast("double")


def compute_metrics(rows: DataFrame, metrics: Iterable[str] = METRICS, by: tuple[str, ...] = ()) -> DataFrame:
    """rows (by..., prediction, reference) -> (by..., the metrics asked for); a metric over no rows is 0.

    rougeL is the mean F of longest common subsequences. bertscore_f1 needs a neural model that is not here; it is
    stood in for by the F of greedily matched tokens (token_match), and named so in the README."""
    asked = list(metrics)
    unknown = set(asked) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    scored = rows
    value = {"em": exact(F.col("prediction"), F.col("reference")), "rougeL": lcs_f(F.col("prediction"), F.col("reference"))}
    if "bertscore_f1" in asked:
        keyed = rows.withColumn("_id", F.sha2(F.to_json(F.struct("prediction", "reference"), {"ignoreNullFields": "false"}), 256))
        pairs = keyed.select("_id", "prediction", "reference").dropDuplicates(["_id"])
        near = token_match(pairs, "_id").select("_id", F.col("f").alias("_near"))
        scored, value["bertscore_f1"] = keyed.join(near, "_id"), F.col("_near")
    return scored.groupBy(*by).agg(*[F.coalesce(F.avg(value[m]), F.lit(0.0)).alias(m) for m in asked])


def results_table(results: DataFrame) -> DataFrame:
    """results (run, metric, value) -> (run, em, rougeL, bertscore_f1, line): one row for each run, a missing metric is 0; line
    is its row of a Markdown table."""
    wide = results.groupBy("run").pivot("metric", list(METRICS)).agg(F.first("value")).na.fill(0.0, list(METRICS))
    return wide.withColumn("line", F.format_string("| %s | %.4f | %.4f | %.4f |", "run", *METRICS)).orderBy("run")


def results_json(results: DataFrame) -> DataFrame:
    """(json): one row, an object of all runs, each an object of its metrics; runs are the few that a report compares."""
    per_run = results.groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    objects = per_run.select(F.to_json(F.create_map("run", "metrics")).alias("json"))
    inner = F.array_sort(F.collect_list(F.expr("substring(json, 2, length(json) - 2)")))
    return objects.agg(F.concat(F.lit("{"), F.array_join(inner, ","), F.lit("}")).alias("json"))


def last_predictions(predictions: DataFrame) -> DataFrame:
    """predictions (id, prediction, line) -> one for each id, that of the last line."""
    return predictions.groupBy("id").agg(F.max_by("prediction", "line").alias("prediction"))


def annotation_set(items: DataFrame, predictions: DataFrame, seed: int = 42) -> DataFrame:
    """items (id, query, answer, history) and predictions (label, id, prediction): for each item all labels' answers, empty
    where one is missing, in an order that hides the labels and depends on the seed only."""
    labels = predictions.select("label").distinct()
    grid = items.select("id").crossJoin(F.broadcast(labels))  # labels are the few systems compared
    answers = grid.join(predictions, ["id", "label"], "left").withColumn("answer", F.coalesce("prediction", F.lit("")))
    lot = F.md5(F.concat_ws(":", F.lit(seed), "id", "label"))
    systems = answers.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct(lot.alias("lot"), "label", "answer"))), lambda s: F.struct(s["label"].alias("label"), s["answer"].alias("answer"))).alias("systems"))
    return items.join(systems, "id").select("id", "query", "history", F.col("answer").alias("reference"), "systems")
