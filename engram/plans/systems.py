"""Answering systems: each item is a bank of its own, so items leave nothing behind for one another.

What a system answers is a Column of the item, or a join with the vectors of its texts; the full system alone folds an item's history in
order, as its links change what later writes see."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.rules import BASELINE_ANSWER, answer, note_fields
from engram.functions.text import embedding_text, is_query
from engram.functions.vector import cosine, hash_embed
from engram.operators.evaluation import METRICS, compute_metrics
from engram.operators.replay import Memory
from engram.plans.learning_queries import ITEMS_SQL, items
from engram.plans.registry import query
from engram.plans.text_queries import QUESTION_SQL
from engram.schema import Params
from engram.shared import written

_ROW = ("dataset", "id", "query", "reference", "history")


def no_memory(rows: DataFrame, p: Params) -> DataFrame:
    return rows.withColumn("prediction", F.lit(BASELINE_ANSWER))


def full_context(rows: DataFrame, p: Params) -> DataFrame:
    return rows.withColumn("prediction", F.array_join("history", "\n"))


def sim_retrieval(rows: DataFrame, p: Params) -> DataFrame:
    """What is nearest in a bank that nothing is written to."""
    return rows.withColumn("prediction", F.lit(""))


def _last() -> Column:
    return F.try_element_at("history", F.lit(-1))


def atomic_linking(rows: DataFrame, p: Params) -> DataFrame:
    """The bank has one note, so that is the nearest, linked or not."""
    return rows.withColumn("prediction", F.coalesce(_last(), F.lit("")))


def write_ops_only(rows: DataFrame, p: Params) -> DataFrame:
    """The same, but a query is not written."""
    return rows.withColumn("prediction", F.when(~is_query(_last()), _last()).otherwise(""))


def value_retrieval_only(rows: DataFrame, p: Params) -> DataFrame:
    """The answer from the one note, if it is similar enough to the query."""
    keyed = rows.withColumn("_last", _last()).withColumn("_key", F.sha2(F.to_json(F.struct("query", "_last")), 256))
    pairs = keyed.where("_last IS NOT NULL").select("_key", "query", "_last").dropDuplicates(["_key"]).withColumn("_f", note_fields(F.col("_last")))
    note = embedding_text(F.col("_last"), F.col("_f.keywords"), F.col("_f.tags"), F.col("_f.description"))
    q, n = (hash_embed(pairs, ["_key"], text, p.dim).withColumnRenamed("embedding", c) for c, text in (("_q", F.col("query")), ("_n", note)))
    near = q.join(n, "_key").where(cosine(F.col("_q"), F.col("_n")) > p.delta).select("_key")
    found = pairs.join(near, "_key").select("_key", answer(F.col("query"), F.array("_last"), F.array("_f.keywords")).alias("_answer"))
    return keyed.join(found, "_key", "left").select(*_ROW, F.coalesce("_answer", F.lit(BASELINE_ANSWER)).alias("prediction"))


def full_system(rows: DataFrame, p: Params) -> DataFrame:
    """All of the history written in order, with links, then the answer."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = []
            for asked, history in zip(frame["query"].tolist(), frame["history"].tolist(), strict=True):
                memory = Memory(p)
                for k, h in enumerate(history):
                    memory.write(f"n{k}", h)
                said.append(memory.answer(asked)[1])
            yield pd.DataFrame({"dataset": frame["dataset"], "id": frame["id"], "query": frame["query"], "reference": frame["reference"], "history": frame["history"], "prediction": said})

    return rows.mapInPandas(run, "dataset string, id string, query string, reference string, history array<string>, prediction string")


SYSTEMS: dict[str, Callable[[DataFrame, Params], DataFrame]] = {
    f.__name__: f for f in (no_memory, full_context, sim_retrieval, atomic_linking, write_ops_only, value_retrieval_only, full_system)
}


def run_systems(items: DataFrame, p: Params = Params(), systems: Iterable[str] | None = None) -> DataFrame:
    """items (dataset, id, query, answer, history) -> (dataset, id, system, prediction, reference): every system on every item.
    Ablations are parameters: link, use_zscore, lam, alpha."""
    past = F.transform(F.coalesce("history", F.array().cast("array<string>")), lambda h: F.coalesce(h, F.lit("")))
    rows = items.select("dataset", F.col("id").cast("string").alias("id"), F.coalesce("query", F.lit("")).alias("query"), F.coalesce("answer", F.lit("")).alias("reference"), past.alias("history"))
    rows, out = written(rows, "items"), None  # each system reads them
    for name in SYSTEMS if systems is None else systems:
        one = SYSTEMS[name](rows, p).select("dataset", "id", F.lit(name).alias("system"), "prediction", "reference")
        out = one if out is None else out.unionByName(one)
    return out


def evaluate(items: DataFrame, p: Params = Params(), metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(run, metric, value), run being dataset/system."""
    scored = compute_metrics(run_systems(items, p), metrics, ("dataset", "system"))
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return scored.select(F.concat_ws("/", "dataset", "system").alias("run"), F.explode(pairs).alias("m")).select("run", "m.metric", "m.value")


@query()
def system_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All systems on the conversations' items; tests hold it against worked cases."""
    return evaluate(items(spark, sf_dir).withColumn("dataset", F.lit("conversations")))


@query()
def system_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("dataset", F.lit("conversations"))
    out = None
    for name, p in (("no_link", Params(link=False)), ("no_zscore", Params(use_zscore=False)), ("lambda_0", Params(lam=0.0)), ("alpha_0.3", Params(alpha=0.3))):
        one = evaluate(rows, p, ("em", "rougeL")).withColumn("ablation", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {ITEMS_SQL}
SELECT conv_id::VARCHAR AS id, system, md5(CASE system WHEN 'no_memory' THEN 'I do not have enough memory context to answer confidently yet.' WHEN 'full_context' THEN coalesce(history, '')
  WHEN 'atomic_linking' THEN coalesce(last, '') WHEN 'write_ops_only' THEN CASE WHEN {QUESTION_SQL.format("last")} THEN '' ELSE coalesce(last, '') END ELSE '' END) AS prediction
FROM items, (SELECT unnest(['no_memory', 'full_context', 'sim_retrieval', 'atomic_linking', 'write_ops_only']) AS system)""")
def system_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the systems without a similarity answer; tests hold the other two against worked cases."""
    rows = items(spark, sf_dir).withColumn("dataset", F.lit("conversations"))
    made = run_systems(rows, systems=("no_memory", "full_context", "sim_retrieval", "atomic_linking", "write_ops_only"))
    return made.select("id", "system", F.md5("prediction").alias("prediction"))
