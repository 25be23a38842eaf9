"""Tables of the memory engine and its parameters."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import types as T

#: A note. ``write_seq`` orders notes by their last write, which is the order of scans.
NOTE = T.StructType([
    T.StructField("bank_id", T.StringType()),
    T.StructField("id", T.StringType(), False),
    T.StructField("content", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("description", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("links", T.ArrayType(T.StringType())),
    T.StructField("intent", T.ArrayType(T.DoubleType())),
    T.StructField("utility", T.DoubleType()),
    T.StructField("write_seq", T.LongType()),
])

#: Short names of a note's fields in its JSON form.
JSON_NAMES = {"id": "id", "content": "c", "ts": "t", "keywords": "K", "tags": "G", "description": "X", "embedding": "e", "links": "L", "intent": "z", "utility": "q"}

EVAL_ITEM = "id string, query string, answer string, history array<string>"
PREDICTION = "id string, prediction string"
RELATION = "array<struct<source string, target string, relation string>>"
FIELDS = "keywords array<string>, tags array<string>, description string"
DECISION = "op string, target_id string"
RESPONSE = "selected_ids array<string>, answer string"
OPS = ("ADD", "UPDATE", "DELETE", "NOOP")


@dataclass(frozen=True)
class Params:
    """Hyperparameters: pool sizes, similarity floor, weight of utility, step size, first utility, vector length."""

    k1: int = 20
    k2: int = 5
    k: int = 5
    delta: float = 0.30
    lam: float = 0.40
    alpha: float = 0.10
    q0: float = 0.50
    use_zscore: bool = True
    link: bool = True
    dim: int = 64

    @classmethod
    def from_json(cls, text: str) -> Params:
        """From a JSON object of the fields; ``lambda`` stands for lam; unknown keys are an error."""
        raw = {"lam" if k == "lambda" else k: v for k, v in json.loads(text).items()}
        unknown = raw.keys() - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        return cls(**raw)
