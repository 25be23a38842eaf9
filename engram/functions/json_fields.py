"""Lenient parsing of model replies: what is malformed or of a wrong type is empty or null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.schema import DECISION, FIELDS, OPS, RELATION, RESPONSE


def parse_fields(raw: Column) -> Column:
    j = F.from_json(raw, FIELDS)
    empty = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(j["keywords"], empty).alias("keywords"), F.coalesce(j["tags"], empty).alias("tags"), F.coalesce(j["description"], F.lit("")).alias("description")
    )


def parse_decision(raw: Column) -> Column:
    """struct(op, target_id): op null if not one of the four in any case; an empty target is null."""
    j = F.from_json(raw, DECISION)
    op = F.upper(j["op"])
    known = op.isin(*OPS)
    return F.struct(F.when(known, op).alias("op"), F.when(known & (j["target_id"] != ""), j["target_id"]).alias("target_id"))


def parse_response(raw: Column) -> Column:
    """struct(selected_ids, answer), null unless both are there."""
    j = F.from_json(raw, RESPONSE)
    return F.when(j["selected_ids"].isNotNull() & j["answer"].isNotNull(), j)


def parse_relations(raw: Column) -> Column:
    """An array of relations; anything but a list is empty, elements that are not objects are dropped."""
    j = F.from_json(raw, RELATION)
    return F.coalesce(F.filter(j, lambda r: r.isNotNull() & (r["source"].isNotNull() | r["target"].isNotNull())), F.from_json(F.lit("[]"), RELATION))


def evolve_reply(raw: Column, keywords: Column, tags: Column, description: Column) -> Column:
    """struct(keywords, tags, description): a missing key keeps the old value; null if the reply can't be parsed."""
    j = F.from_json(raw, FIELDS + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    new = F.struct(
        F.coalesce(j["keywords"], keywords).alias("keywords"), F.coalesce(j["tags"], tags).alias("tags"), F.coalesce(j["description"], description).alias("description")
    )
    return F.when(j["_corrupt"].isNull() & raw.isNotNull(), new)
