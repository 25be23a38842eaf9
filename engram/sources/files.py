"""Readers and writers of evaluation data, predictions, results, prompts and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.schema import EVAL_ITEM, JSON_NAMES
from engram.shared import delete, written

DATASETS = ("longmemeval", "locomo", "personalmembench")


def read_jsonl(spark: SparkSession, path: str, schema: str = EVAL_ITEM) -> DataFrame:
    """A JSON object on each line; blank lines are skipped, a malformed line is an error, missing keys are empty."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    empty = {"string": F.lit(""), "array<string>": F.array().cast("array<string>")}
    return rows.select(*[F.coalesce(F.col(c), empty[t]).alias(c) if t in empty and c != "id" else F.col(c) for c, t in rows.dtypes])


def load_datasets(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The items of several datasets, told apart by the column dataset."""
    out = None
    for name, path in paths.items():
        rows = read_jsonl(spark, path).withColumn("dataset", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no dataset given")
    return out


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(id, prediction), the last line of an id; a line without id or prediction is an error."""
    from engram.operators.evaluation import last_predictions

    # Files in the order of their paths, then splits by offset; within a split ids rise with the lines.
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("id"))
    lines = spark.read.text(path).select("value", at.alias("line")).where(F.trim("value") != "")
    j = F.from_json("value", "id string, prediction string", {"mode": "FAILFAST"})
    rows = lines.select(j.alias("j"), "line").select(F.col("j.id").alias("id"), F.col("j.prediction").alias("prediction"), "line")
    whole = F.assert_true(F.col("id").isNotNull() & F.col("prediction").isNotNull(), "a prediction needs id and prediction")
    return last_predictions(rows.where(whole.isNull()))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(run, metric, value) from a JSON object of runs and their metrics."""
    schema = T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("runs"))
    runs = text.select(F.explode("runs").alias("run", "metrics"))
    return runs.select("run", F.explode("metrics").alias("metric", "value"))


def read_template(spark: SparkSession, path: str) -> str:
    """A prompt, whole."""
    return spark.read.text(path, wholetext=True).first()["value"]


def filled(template: str, **columns):
    """A template with each {name} replaced by a column; {{ and }} stand for braces."""
    from string import Formatter

    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            parts.append(columns[name].cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def note_json(notes: DataFrame) -> DataFrame:
    """(id, json): each note under its short names, for interchange; tables keep native arrays."""
    pairs = [F.col(c).alias(short) if c != "ts" else F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(short) for c, short in JSON_NAMES.items()]
    return notes.select("id", F.to_json(F.struct(*pairs), {"ignoreNullFields": "false"}).alias("json"))


def notes_from_json(rows: DataFrame) -> DataFrame:
    """The notes of a column json: missing lists are empty, a missing description empty, a missing utility 0."""
    j = F.from_json("json", "id string, c string, t string, K array<string>, G array<string>, X string, e array<double>, L array<string>, z array<double>, q double")
    strings, numbers = F.array().cast("array<string>"), F.array().cast("array<double>")
    return rows.select(j.alias("j")).select(
        F.col("j.id").alias("id"), F.col("j.c").alias("content"), F.to_timestamp("j.t").alias("ts"),
        *[F.coalesce(F.col(f"j.{s}"), strings).alias(c) for c, s in (("keywords", "K"), ("tags", "G"), ("links", "L"))],
        F.coalesce("j.X", F.lit("")).alias("description"),
        *[F.coalesce(F.col(f"j.{s}"), numbers).alias(c) for c, s in (("embedding", "e"), ("intent", "z"))],
        F.coalesce("j.q", F.lit(0.0)).alias("utility"),
    )


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


ANNOTATION = "id string, query string, history array<string>, reference string, systems array<struct<label: string, answer: string>>"


def read_annotations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """An annotation set, a JSON array of items or one item on each line. ``lines``: an array as write_annotations lays it out, which is read
    in as many tasks as it has splits; a malformed item is an error."""
    if not lines:
        return spark.read.schema(ANNOTATION).option("multiLine", True).json(path)
    # Brackets alone are null and no item, wherever the filter is put.
    item = F.when(~F.col("value").isin("]", "[]", ""), F.regexp_replace("value", r"^[\[,]", ""))
    items = spark.read.text(path).select(item.alias("value")).where("value IS NOT NULL")
    return items.select(F.from_json("value", ANNOTATION, {"mode": "FAILFAST"}).alias("j")).select("j.*")


def _item_json() -> Column:
    return F.to_json(F.struct("id", "query", "history", "reference", "systems"))


def annotation_array(rows: DataFrame) -> DataFrame:
    """(json): a set that is small enough for one row as one JSON array in the order of ids; write_annotations takes any."""
    items = F.array_sort(F.collect_list(F.struct("id", _item_json().alias("item"))))
    return rows.agg(F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: x["item"]), ","), F.lit("]")).alias("json"))


def write_annotations(rows: DataFrame, path: str) -> None:
    """The set as one JSON array in the order of ids, the form that annotators load: an item a line, each but the first after a comma, in part
    files that are the array when they are put together in the order of their names."""
    made = written(rows.select("id", _item_json().alias("item")), "items")  # so that rows have the same places in both passes
    placed = made.select(F.struct("id", F.monotonically_increasing_id().alias("n")).alias("at"), "item")  # the driver samples places, not items
    first = placed.agg(F.min("at").alias("first"))  # one row
    items = placed.crossJoin(F.broadcast(first)).select(
        F.lit(0).alias("end"), "at", F.concat(F.when(F.col("at").eqNullSafe(F.col("first")), "[").otherwise(","), "item").alias("value")
    )
    end = first.select(F.lit(1).alias("end"), F.lit(None).cast(placed.schema["at"].dataType).alias("at"), F.when(F.col("first").isNull(), "[]").otherwise("]").alias("value"))
    items.unionByName(end).orderBy("end", "at").select("value").write.text(path)
    delete(made)


def responses(annotations: DataFrame, given: DataFrame) -> DataFrame:
    """(id, query, systems, responses) of each item: given (id, label, score) as a map, empty where nobody answered."""
    per_item = given.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "score")))).alias("responses"))
    none = F.create_map().cast("map<string,double>")
    return annotations.join(per_item, "id", "left").select("id", "query", "systems", F.coalesce(F.col("responses").cast("map<string,double>"), none).alias("responses"))
