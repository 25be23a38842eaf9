"""Semantic likeness of two texts by greedy matching of their tokens.

Every token of the reference looks for the token of the prediction that is most like it, and the other way round; the likeness of
two tokens is the cosine of their hashed character trigrams, so inflected words match in part. Tokens weigh by how rare they are among the
references: recall is the weighted mean over the reference's tokens, precision over the prediction's, F their harmonic mean. It
stands where a neural score would. Token counts and weights are joins and aggregates; a pair's own tokens meet in one matrix product.

A null text is empty; a pair of which one side has no token scores 0."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.text import tokens
from engram.shared import written

#: Places of a token's vector (one byte of a hash), characters of a gram; tokens whose vectors a worker remembers.
PLACES, GRAM, KNOWN = 256, 3, 50_000
_vectors: dict[str, np.ndarray] = {}
#: Characters of texts whose tokens one task counts; tokens take many times the room of the packed texts by which Spark deals them out.
CHARACTERS = 4_000_000


def token_vector(token: str) -> np.ndarray:
    """The unit vector of a token's trigrams, its ends marked."""
    found = _vectors.get(token)
    if found is None:
        if len(_vectors) >= KNOWN:
            _vectors.clear()
        marked, found = f"<{token}>", np.zeros(PLACES)
        for i in range(len(marked) - GRAM + 1):
            found[hashlib.md5(marked[i : i + GRAM].encode()).digest()[-1]] += 1.0
        found = _vectors[token] = found / np.sqrt(found @ found)
    return found


def _matched(predicted: pd.Series, p_weight: pd.Series, wanted: pd.Series, r_weight: pd.Series) -> pd.DataFrame:
    out = []
    for p, pw, r, rw in zip(predicted, p_weight, wanted, r_weight, strict=True):
        if p is None or r is None or not len(p) or not len(r):
            out.append((0.0, 0.0, 0.0))
            continue
        near = np.array([token_vector(t) for t in p]) @ np.array([token_vector(t) for t in r]).T
        pw, rw = np.asarray(pw, dtype=np.float64), np.asarray(rw, dtype=np.float64)
        precision, recall = float(near.max(axis=1) @ pw / pw.sum()), float(near.max(axis=0) @ rw / rw.sum())
        out.append((precision, recall, 2 * precision * recall / (precision + recall) if precision + recall > 0 else 0.0))
    return pd.DataFrame(out, columns=["precision", "recall", "f"])


def rarity(references: DataFrame) -> DataFrame:
    """(token, idf) of references (reference), each row a text: 1 + ln((N + 1) / (texts with it + 1))."""
    words = references.select(F.explode(F.array_distinct(tokens(F.col("reference")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return words.crossJoin(F.broadcast(references.agg(F.count("*").alias("n")))).select("token", (1 + F.log((F.col("n") + 1.0) / (F.col("df") + 1))).alias("idf"), "n")  # one row


def _spread(texts: DataFrame, key: str) -> DataFrame:
    """texts by key in as many partitions as their characters ask for; a text's tokens are then counted where it is."""
    characters = texts.agg(F.sum(F.length("prediction").cast("long") + F.length("reference"))).first()[0] or 0
    return texts.repartition(max(1, -(-characters // CHARACTERS)), key)


def token_match(pairs: DataFrame, key: str = "pair") -> DataFrame:
    """pairs (key, prediction, reference), keys distinct -> (key, precision, recall, f). Weights are of the distinct references given."""
    texts = written(pairs.select(key, F.coalesce("prediction", F.lit("")).alias("prediction"), F.coalesce("reference", F.lit("")).alias("reference")), "texts")
    references = texts.select("reference").distinct()
    sides = _spread(texts, key).select(key, F.explode(F.array(F.struct(F.lit(0).alias("side"), tokens(F.col("prediction")).alias("t")), F.struct(F.lit(1).alias("side"), tokens(F.col("reference")).alias("t")))).alias("s"))
    counts = sides.select(key, "s.side", F.explode("s.t").alias("token")).groupBy(key, "side", "token").agg(F.count("*").alias("c"))
    unseen = references.agg((1 + F.log(F.count("*") + 1.0)).alias("most"))
    weighed = counts.join(rarity(references).drop("n"), "token", "left").crossJoin(F.broadcast(unseen)).select(key, "side", "token", (F.col("c") * F.coalesce("idf", "most")).alias("weight"))  # one row
    of = lambda side: F.collect_list(F.when(F.col("side") == side, F.struct("token", "weight")))  # noqa: E731  a text's own tokens
    listed = weighed.groupBy(key).agg(of(0).alias("p"), of(1).alias("r"))
    columns: list[Column] = [F.col(c)[f] for c in ("p", "r") for f in ("token", "weight")]
    scored = listed.select(F.col(key).alias("_key"), F.pandas_udf(_matched, "struct<precision: double, recall: double, f: double>")(*columns).alias("m"))
    joined = texts.select(key).join(scored, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.select(key, *[F.coalesce(F.col(f"m.{c}"), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f")])
