"""What the rules reply to a stage's prompt, as Columns: the deterministic stand-in for a model.

A prompt names its stage after a marker, and what the stage needs between labels. A prompt of no known stage gets an empty object; a
part that cannot be read counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.functions.rules import BASELINE_ANSWER, answer, evolved_description, lowered, note_fields, overlap_score, relation_label
from engram.functions.text import block_between, is_query, let, stripped

#: Stages, and the labels of a prompt's parts.
MARKER = "STAGE="
STAGES = ("NOTE", "WRITE_OP", "LINK", "EVOLVE", "ANSWER", "BASELINE", "SUMMARY")
_NOTE = "id string, keywords array<string>, tags array<string>, description string, content string, utility double"
_KEPT = {"ignoreNullFields": "false"}


def _strings(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def note_reply(prompt: Column) -> Column:
    return F.to_json(note_fields(block_between(prompt, "CONTENT:")))


def write_op_reply(prompt: Column) -> Column:
    content, memory = block_between(prompt, "CONTENT:", "MEMORY:"), F.from_json(block_between(prompt, "MEMORY:"), "array<struct<id: string, keywords: array<string>>>")

    def decided(wanted: Column) -> Column:
        hits = F.filter(memory, lambda n: F.coalesce(F.arrays_overlap(lowered(_strings(n["keywords"])), wanted), F.lit(False)))
        target = F.when(~is_query(content), F.try_element_at(hits, F.lit(1))["id"])
        op = F.when(is_query(content), "NOOP").when(F.size(hits) > 0, "UPDATE").otherwise("ADD")
        return F.to_json(F.struct(op.alias("op"), target.alias("target_id")), _KEPT)

    return let(lowered(note_fields(content)["keywords"]), decided)


def link_reply(prompt: Column) -> Column:
    """Relations to the first two neighbours that are not the note itself."""
    kind = "id string, tags array<string>"
    new, near = F.from_json(block_between(prompt, "NEW_NOTE:", "NEIGHBORS:"), kind), F.from_json(block_between(prompt, "NEIGHBORS:"), "array<struct<id: string, tags: array<string>>>")
    own = F.coalesce(new["id"], F.lit(""))
    others = F.slice(F.filter(F.coalesce(near, F.array().cast("array<struct<id: string, tags: array<string>>>")), lambda n: (F.coalesce(n["id"], F.lit("")) != "") & (n["id"] != own)), 1, 2)
    return F.to_json(F.transform(others, lambda n: F.struct(own.alias("source"), n["id"].alias("target"), relation_label(_strings(new["tags"]), _strings(n["tags"])).alias("relation"))))


def evolve_reply(prompt: Column) -> Column:
    kind = "keywords array<string>, tags array<string>, description string"
    old, new = F.from_json(block_between(prompt, "EXISTING_NOTE:", "NEW_NOTE:"), kind), F.from_json(block_between(prompt, "NEW_NOTE:"), kind)
    merged = [F.array_union(_strings(old[c]), _strings(new[c])).alias(c) for c in ("keywords", "tags")]
    return F.to_json(F.struct(*merged, evolved_description(old["description"], new["description"]).alias("description")))


def answer_reply(prompt: Column) -> Column:
    """The two candidates with most in common with the query, ties in their order, and the answer from them."""
    asked = block_between(prompt, "QUERY:", "CANDIDATES:")
    kind = f"array<struct<{', '.join(': '.join(c.split(' ', 1)) for c in _NOTE.split(', '))}>>"
    given = F.coalesce(F.from_json(block_between(prompt, "CANDIDATES:"), kind), F.from_json(F.lit("[]"), kind))

    def replied(notes: Column) -> Column:
        score = lambda n: overlap_score(asked, F.coalesce(n["content"], F.lit("")), _strings(n["keywords"]), F.coalesce(n["utility"], F.lit(0.0)))
        ranked = F.array_sort(F.transform(notes, lambda n, i: F.struct((-score(n)).alias("less"), i.alias("place"), n.alias("note"))))

        def told(best: Column) -> Column:
            ids = F.filter(F.transform(best, lambda r: F.coalesce(r["note"]["id"], F.lit(""))), lambda i: i != "")
            contents, words = F.transform(best, lambda r: F.coalesce(r["note"]["content"], F.lit(""))), F.transform(best, lambda r: _strings(r["note"]["keywords"]))
            return F.to_json(F.struct(ids.alias("selected_ids"), answer(asked, contents, words).alias("answer")))

        return let(F.slice(ranked, 1, 2), told)

    return let(given, replied)


def summary_reply(prompt: Column) -> Column:
    parts = (("Query: ", "QUERY:", "ANSWER:"), (" | Answer: ", "ANSWER:", "REWARD:"), (" | Reward: ", "REWARD:", None))
    return F.concat(*[x for label, start, end in parts for x in (F.lit(label), stripped(block_between(prompt, start, end)))])


def reply(prompt: Column, marker: str = MARKER) -> Column:
    """The reply to any stage's prompt; null to none."""
    by_stage = {
        "NOTE": note_reply, "WRITE_OP": write_op_reply, "LINK": link_reply, "EVOLVE": evolve_reply, "ANSWER": answer_reply,
        "BASELINE": lambda p: F.lit(BASELINE_ANSWER), "SUMMARY": summary_reply,
    }
    stage = F.regexp_extract(prompt, rf"{marker}({'|'.join(STAGES)})(?![A-Z_])", 1)
    out = F.when(prompt.isNull(), F.lit(None).cast("string"))
    for name in STAGES:
        out = out.when(stage == name, by_stage[name](prompt))
    return out.otherwise("{}")
