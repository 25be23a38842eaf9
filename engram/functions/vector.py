"""Vector functions as Columns, and hashed token embeddings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.text import tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def unit(a: Column) -> Column:
    """Length 1; a zero vector stays."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x / norm(a))).otherwise(a)


def bucket(token: Column, dim: int = 64) -> Column:
    """The md5 of a token as a number, modulo dim (a divisor of 256: the last byte decides)."""
    if 256 % dim:
        raise ValueError("dim must divide 256")
    return F.conv(F.substring(F.md5(token), 31, 2), 16, 10).cast("int") % dim


def hash_buckets(df: DataFrame, keys: list[str], text: Column, dim: int = 64) -> DataFrame:
    """(keys, bucket, n): token counts by bucket; a text without a token counts as the token "empty"."""
    found = tokens(F.coalesce(text, F.lit("")))
    words = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("empty")))
    return df.select(*keys, F.explode(words).alias("_token")).groupBy(*keys, bucket(F.col("_token"), dim).alias("bucket")).agg(F.count("*").alias("n"))


def hash_weights(df: DataFrame, keys: list[str], text: Column, dim: int = 64) -> DataFrame:
    """(keys, bucket, weight): the non-zero places of the unit vector of each text."""
    counts = hash_buckets(df, keys, text, dim)
    norms = counts.groupBy(*keys).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("_norm"))
    return counts.join(norms, keys).select(*keys, "bucket", (F.col("n") / F.col("_norm")).alias("weight"))


def hash_embed(df: DataFrame, keys: list[str], text: Column, dim: int = 64) -> DataFrame:
    """(keys, embedding): dense unit vectors, one aggregate after the counts."""
    counts = hash_buckets(df, keys, text, dim)
    entries = F.map_from_entries(F.collect_list(F.struct("bucket", "n")))
    packed = counts.groupBy(*keys).agg(entries.alias("_at"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("_norm"))
    value = lambda i: F.coalesce(F.try_element_at("_at", i), F.lit(0)) / F.col("_norm")
    return packed.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value).alias("embedding"))


def lcs_f(prediction: Column, reference: Column) -> Column:
    """ROUGE-L F of two texts: longest common subsequence of tokens, in batches of rows."""
    return F.pandas_udf(_lcs, "double")(prediction, reference)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Bit-parallel: a row of the table is one number whose zero bits are the places of b at which the row steps up, so a word of a costs
    an addition and a mask over all of b."""
    places: dict[str, list[int]] = {}
    for i, w in enumerate(b):
        places.setdefault(w, []).append(i)
    masks = {}
    for w in set(a) & places.keys():
        bits = bytearray(len(b) // 8 + 1)
        for i in places[w]:
            bits[i >> 3] |= 1 << (i & 7)
        masks[w] = int.from_bytes(bits, "little")
    whole = row = (1 << len(b)) - 1
    for w in a:
        mask = masks.get(w)
        if mask:
            hit = row & mask
            row = (row + hit | row - hit) & whole
    return len(b) - row.bit_count()


def _lcs(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    def f(p: str | None, r: str | None) -> float:
        a, b = (re.findall("[a-z0-9]+", (x or "").lower()) for x in (p, r))
        return 2.0 * lcs_length(a, b) / (len(a) + len(b)) if a and b else 0.0

    return prediction.combine(reference, f)
