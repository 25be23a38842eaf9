"""What generates text and embeds it: rules as Columns by default, or any Python functions in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions import stage_rules
from engram.functions.vector import hash_embed


@dataclass(frozen=True)
class Backend:
    """generate: a prompt's reply; embed: (rows, keys, text) -> (keys, embedding)."""

    name: str
    generate: Callable[[Column], Column]
    embed: Callable[[DataFrame, list[str], Column], DataFrame]


def rules(dim: int = 64) -> Backend:
    """The deterministic default: each stage's prompt gets what its rules reply, texts get hashed embeddings."""
    return Backend("rules", stage_rules.reply, lambda df, keys, text: hash_embed(df, keys, text, dim))


def functions(load: Callable[[], tuple[Callable[[list[str]], list[str]], Callable[[list[str]], list[list[float]]]]]) -> Backend:
    """A backend of batch functions; load runs once in each task and returns (generate, embed). ``operators.replies`` asks each prompt once and
    keeps what was answered."""

    @F.pandas_udf("string")
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = load()[0]
        for b in batches:
            yield pd.Series(f(b.tolist()))

    @F.pandas_udf("array<double>")
    def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = load()[1]
        for b in batches:
            yield pd.Series(f(b.tolist()))

    return Backend("functions", generate, lambda df, keys, text: df.select(*keys, vector(text).alias("embedding")))


_MADE: dict[str, Callable[..., Backend]] = {"rules": rules, "functions": functions}


def register(name: str, make: Callable[..., Backend]) -> None:
    _MADE[name] = make


def build(name: str, *args, **options) -> Backend:
    if name not in _MADE:
        raise ValueError(f"unknown backend {name!r}; known: {sorted(_MADE)}")
    return _MADE[name](*args, **options)
