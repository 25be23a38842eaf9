"""A Bloom filter of fixed size over hashes, made by Spark and broadcast. As it fills up it lets more through, and loses nothing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The filter has 2^FILTER_BITS bits.
FILTER_BITS = 24


def row_filter(rows: DataFrame) -> np.ndarray:
    """The filter of the column ``row``, hashes already, as words of 32 bits."""
    h = F.col("row")
    bits = rows.select(F.explode(F.array(F.shiftrightunsigned(h, 64 - FILTER_BITS), h.bitwiseAND(F.lit((1 << FILTER_BITS) - 1)))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits"))
    table = np.zeros(1 << (FILTER_BITS - 5), dtype=np.uint32)
    found = words.toArrow()  # at most 2^(FILTER_BITS - 5) rows
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return table


def may_hold(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Of each hash (unsigned), whether the filter may hold it."""
    ok = np.ones(len(h), dtype=bool)
    for bit in (h >> np.uint64(64 - FILTER_BITS), h & np.uint64((1 << FILTER_BITS) - 1)):
        ok &= (table[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
    return ok
