"""Utilities learned from rewards by an exponential moving average."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Rewards of a block, whose powers of 1 - alpha stay above LEAST; below it a power counts as nothing.
BLOCK, LEAST, NOTHING = 256, -100.0, -324.0


def _chunks(rewards: DataFrame, alpha: float, span: str) -> tuple[DataFrame, DataFrame]:
    """(ranked, chunks): rewards (key, ts, seq, reward) ranked within the chunk of their key and span of time, and of each
    chunk its number of steps n and b, so that it takes q to (1 - alpha)^n q + b. A null reward is no step."""
    chunked = rewards.where("reward IS NOT NULL").withColumn("chunk", F.date_trunc(span, "ts"))
    w = W.partitionBy("key", "chunk")
    ranked = chunked.withColumn("i", F.row_number().over(w.orderBy("ts", "seq"))).withColumn("m", F.count("*").over(w))
    step = F.col("reward") * alpha * F.pow(F.lit(1.0 - alpha), F.col("m") - F.col("i"))
    return ranked, ranked.groupBy("key", "chunk").agg(F.sum(step).alias("b"), F.count("*").alias("n"))


def ema(rewards: DataFrame, alpha: float = 0.1, q0: float = 0.5, span: str = "day") -> DataFrame:
    """(key, steps, utility) after all rewards of each key in the order of (ts, seq).

    q <- q + alpha (r - q) is affine in q, so stretches of time are folded on their own and composed: a key with very many
    rewards is spread over its chunks."""
    _, chunks = _chunks(rewards, alpha, span)
    later = F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("chunk").rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    parts = chunks.withColumn("part", F.col("b") * F.pow(F.lit(1.0 - alpha), later))
    total = parts.groupBy("key").agg(F.sum("n").alias("steps"), F.sum("part").alias("b"))
    return total.select("key", "steps", (F.pow(F.lit(1.0 - alpha), "steps") * q0 + F.col("b")).alias("utility"))


def _block_size(alpha: float) -> int:
    """Rewards of a block: the inverse of the least power in it stays far within range."""
    return BLOCK if alpha <= 0.0 else max(1, min(BLOCK, int(LEAST / math.log10(1.0 - alpha))))


def _composed(blocks: DataFrame, alpha: float) -> DataFrame:
    """blocks (key, chunk, block, n, b) with done and start_a, start_b: the steps before, and what takes the first utility to the block's start.

    The map of a block is q -> (1 - alpha)^n q + b; maps are composed with those 1, 2, 4, ... blocks before in turn, so after k rounds each
    covers the 2^k blocks up to its own. Rounds end when what is left out has no digit in double precision."""
    order = W.partitionBy("key").orderBy("chunk", "block")
    keep = F.lit(1.0 - alpha)
    out = blocks.withColumn("a", F.pow(keep, "n")).withColumn("done", F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # A block has one reward at least; where chunks are short, that many blocks are needed to forget.
    forget = 1 if alpha <= 0.0 else NOTHING / math.log10(1.0 - alpha) + 1  # without a step size there is nothing to carry
    step = 1
    while step < forget:
        a, b = (F.lag(c, step).over(order) for c in ("a", "b"))
        out = out.withColumns({"a": F.coalesce(F.col("a") * a, F.col("a")), "b": F.col("b") + F.coalesce(F.col("a") * b, F.lit(0.0))})
        step *= 2
    return out.withColumns({"start_a": F.coalesce(F.lag("a", 1).over(order), F.lit(1.0)), "start_b": F.coalesce(F.lag("b", 1).over(order), F.lit(0.0))})


def ema_trajectory(rewards: DataFrame, alpha: float = 0.1, q0: float = 0.5, span: str = "day") -> DataFrame:
    """(key, step, seq, utility) after each reward: a prefix scan of affine maps on two levels. Rewards of a block of a chunk are summed up
    with growing weights, blocks are composed by doubling; both are windows in linear space, whatever a key's share of the rewards."""
    if alpha >= 1.0:  # the last reward is all
        ranked = rewards.where("reward IS NOT NULL").withColumn("step", F.row_number().over(W.partitionBy("key").orderBy("ts", "seq")).cast("long"))
        return ranked.select("key", "step", "seq", (F.lit(alpha) * F.col("reward")).cast("double").alias("utility"))
    size, keep = _block_size(alpha), F.lit(1.0 - alpha)
    ranked, _ = _chunks(rewards, alpha, span)
    placed = ranked.withColumns({"block": F.floor((F.col("i") - 1) / size), "j": (F.col("i") - 1) % size + 1})
    within = W.partitionBy("key", "chunk", "block").orderBy("j").rowsBetween(W.unboundedPreceding, 0)
    inner = placed.withColumn("b", F.sum(F.col("reward") * alpha * F.pow(keep, -F.col("j"))).over(within) * F.pow(keep, "j"))
    blocks = inner.groupBy("key", "chunk", "block").agg(F.max("j").alias("n"), F.max_by("b", "j").alias("b"))
    starts = _composed(blocks, alpha).select(F.col("key").alias("s_key"), F.col("chunk").alias("s_chunk"), F.col("block").alias("s_block"), "done", "start_a", "start_b")
    same = F.col("key").eqNullSafe(F.col("s_key")) & F.col("chunk").eqNullSafe(F.col("s_chunk")) & (F.col("block") == F.col("s_block"))
    q = F.pow(keep, "j") * (F.col("start_a") * q0 + F.col("start_b")) + F.col("b")
    return inner.join(starts, same).select("key", (F.col("done") + F.col("j")).alias("step"), "seq", q.alias("utility"))


def group_advantage(rewards: DataFrame, group: str, reward: str) -> DataFrame:
    """rewards with advantage: (r - mean) / population deviation of its group, 0 without spread. Group statistics are aggregated
    and joined, so a large group is not gathered; rows without a group are one."""
    stats = rewards.groupBy(F.col(group).alias("_group")).agg(F.avg(reward).alias("_mean"), F.stddev_pop(reward).alias("_std"))
    z = F.when(F.col("_std") < 1e-12, 0.0).otherwise((F.col(reward) - F.col("_mean")) / F.col("_std"))
    return rewards.join(stats, F.col(group).eqNullSafe(F.col("_group"))).withColumn("advantage", z).drop("_group", "_mean", "_std")


def utility_change(before: DataFrame, after: DataFrame, used: DataFrame) -> DataFrame:
    """(id, q_before, q_after) of the used notes that are in both tables."""
    a = before.select("id", F.col("utility").alias("q_before"))
    return used.select("id").distinct().join(a, "id").join(after.select("id", F.col("utility").alias("q_after")), "id")
