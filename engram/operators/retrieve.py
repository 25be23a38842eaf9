"""Two-phase retrieval: nearest neighbours above a similarity, then re-ranking by similarity and utility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.operators.knn import knn
from engram.schema import Params

#: A standard deviation below this is none: equal values whose mean was rounded.
FLAT = 1e-12


def zscore(value: str, *group: str) -> Column:
    """(x - mean) / population deviation within a group; 0 in a group without spread."""
    w = W.partitionBy(*group)
    spread = F.stddev_pop(value).over(w)
    return F.when(spread < FLAT, 0.0).otherwise((F.col(value) - F.avg(value).over(w)) / spread)


def candidates(queries: DataFrame, bank: DataFrame, p: Params = Params()) -> DataFrame:
    """Phase one: (query_id, vec_id, sim, rank), the k1 nearest that are more similar than delta."""
    return knn(queries, bank, p.k1).where(F.col("sim") > p.delta)


def rerank(pool: DataFrame, p: Params = Params()) -> DataFrame:
    """Phase two over pool (query_id, vec_id, sim, rank, utility): (query_id, vec_id, place, sim, score), the best k2; equal
    scores keep the order of similarity."""
    if p.use_zscore:
        pool = pool.withColumn("_s", zscore("sim", "query_id")).withColumn("_q", zscore("utility", "query_id"))
    else:
        pool = pool.withColumn("_s", F.col("sim")).withColumn("_q", F.col("utility"))
    scored = pool.withColumn("score", (1.0 - p.lam) * F.col("_s") + p.lam * F.col("_q"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= p.k2).select("query_id", "vec_id", "place", "sim", "score")


def hybrid_retrieve(queries: DataFrame, bank: DataFrame, p: Params = Params()) -> DataFrame:
    """queries (query_id, embedding) against bank (vec_id, embedding, utility)."""
    near = candidates(queries, bank.select("vec_id", "embedding"), p)
    return rerank(near.join(bank.select("vec_id", "utility"), "vec_id"), p)


def distil(pool: DataFrame, keep: int = 2) -> DataFrame:
    """pool (query_id, id, overlap score, place) -> the best ``keep`` of each query; ties keep their place, empty ids go."""
    order = W.partitionBy("query_id").orderBy(F.desc("overlap"), "place")
    return pool.withColumn("pick", F.row_number().over(order)).where((F.col("pick") <= keep) & (F.col("id") != ""))


def context(pool: DataFrame, bullet: str = "- ") -> DataFrame:
    """(query_id, context): the contents of each query's notes in the order of place, a line each."""
    rows = F.array_sort(F.collect_list(F.struct("place", "content")))
    return pool.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: F.concat(F.lit(bullet), r["content"])), "\n").alias("context"))


def distil_and_answer(queries: DataFrame, pool: DataFrame, replies: DataFrame, baseline: Column) -> DataFrame:
    """(query_id, ids, answer): queries (query_id), pool (query_id, id, place), replies (query_id, reply).

    A query without candidates gets the baseline and no ids, an unreadable reply the baseline and all ids, one that selects none
    of the candidates its answer and all ids."""
    from engram.functions.json_fields import parse_response

    ids = pool.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda r: r["id"]).alias("ids"))
    joined = queries.join(ids, "query_id", "left").join(replies, "query_id", "left")
    parsed = parse_response(F.col("reply"))
    chosen = F.filter("ids", lambda i: F.array_contains(parsed["selected_ids"], i))
    empty = F.array().cast("array<string>")
    return joined.select(
        "query_id",
        F.when(F.col("ids").isNull(), empty).when(parsed.isNull() | (F.size(chosen) == 0), F.col("ids")).otherwise(chosen).alias("ids"),
        F.when(F.col("ids").isNull() | parsed.isNull(), baseline).otherwise(parsed["answer"]).alias("answer"),
    )
