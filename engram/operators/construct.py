"""Notes from contents: fields, two embeddings, first utility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.backends import Backend, rules
from engram.functions.json_fields import parse_fields
from engram.functions.rules import note_fields
from engram.functions.text import embedding_text
from engram.schema import NOTE, Params


def build_notes(facts: DataFrame, p: Params = Params(), backend: Backend | None = None, reply: Column | None = None) -> DataFrame:
    """facts (bank_id, id, content, ts, write_seq) -> notes. reply: a column with a model's JSON fields; without one the rules
    decide. The embedding is of content, keywords, tags and description, the intent of the content alone."""
    backend = backend or rules(p.dim)
    made = parse_fields(reply) if reply is not None else note_fields(F.col("content"))
    rows = facts.withColumn("_f", made).select("*", "_f.*").drop("_f")
    text = embedding_text(F.col("content"), F.col("keywords"), F.col("tags"), F.col("description"))
    keys = ["bank_id", "id"]
    e = backend.embed(rows, keys, text).toDF("e_bank", "e_id", "embedding")
    z = backend.embed(rows, keys, F.col("content")).toDF("z_bank", "z_id", "intent")
    same = lambda k: F.col("bank_id").eqNullSafe(F.col(f"{k}_bank")) & (F.col("id") == F.col(f"{k}_id"))  # noqa: E731  a null bank is a bank
    full = rows.join(e, same("e")).join(z, same("z")).withColumn("links", F.array().cast("array<string>")).withColumn("utility", F.lit(p.q0))
    return full.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in NOTE])
