"""The deterministic rules that stand for a language model, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.functions.text import first_tokens, let, name_in, pet_names, stripped, titled, tokens

#: Answers and descriptions of the rules.
JOB_DESCRIPTION = "User works as a data scientist at a tech company."
JOB_ANSWER = "You work as a data scientist at a tech company."
NO_DOGS, NO_NAME, NO_CONTEXT = "I could not find your dog names in memory yet.", "I could not find your name in memory yet.", "I need more context."
BASELINE_ANSWER = "I do not have enough memory context to answer confidently yet."


def _strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def note_fields(content: Column) -> Column:
    """struct(keywords, tags, description): the rules for names, dogs and work add up, and the last one describes the note."""
    return let(stripped(content), lambda text: let(F.lower(text), lambda low: _fields(text, low)))


def _fields(text: Column, low: Column) -> Column:
    found = F.struct(
        name_in(text).alias("name"), pet_names(text).alias("pets"), low.contains("name is").alias("named"),
        (low.contains("dog") | low.contains("buddy") | low.contains("scout")).alias("dogs"),
        (low.contains("work") | low.contains("job") | low.contains("scientist")).alias("work"),
        F.array_distinct(first_tokens(low, 4)).alias("first"),
    )
    return let(found, lambda x: _described(text, x))


def _described(text: Column, found: Column) -> Column:
    name, pets, dogs, work, first = (found[c] for c in ("name", "pets", "dogs", "work", "first"))
    named = found["named"] & (name != "")
    nothing = _strings()
    keywords = F.array_distinct(F.concat(
        F.when(named, F.concat(F.array(name), _strings("name", "identity"))).otherwise(nothing),
        F.when(dogs, F.concat(_strings("dog", "pet"), pets)).otherwise(nothing),
        F.when(work, _strings("job", "career", "data scientist")).otherwise(nothing),
    ))
    tags = F.array_distinct(F.concat(
        F.when(named, _strings("profile", "personal")).otherwise(nothing),
        F.when(dogs, _strings("pets")).otherwise(nothing),
        F.when(work, _strings("career", "professional")).otherwise(nothing),
    ))
    general = ~(named | dogs | work)
    description = (
        F.when(work, F.lit(JOB_DESCRIPTION))
        .when(dogs & (F.size(pets) > 0), F.concat(F.lit("User has dog(s): "), titled(pets), F.lit(".")))
        .when(named, F.concat(F.lit("User's name is "), F.initcap(name), F.lit(".")))
        .otherwise(text)
    )
    return F.struct(
        F.when(~general, keywords).when(F.size(first) > 0, first).otherwise(_strings("general")).alias("keywords"),
        F.when(general, _strings("general")).otherwise(tags).alias("tags"),
        description.alias("description"),
    )


def lowered(values: Column) -> Column:
    return F.transform(values, F.lower)


def relation_label(new_tags: Column, other_tags: Column) -> Column:
    return F.when(F.arrays_overlap(lowered(new_tags), lowered(other_tags)), "same-domain").otherwise("semantic-related")


def evolved_description(old: Column, new: Column) -> Column:
    old, new = stripped(F.coalesce(old, F.lit(""))), stripped(F.coalesce(new, F.lit("")))
    joined = F.regexp_replace(F.concat(old, F.lit(" | Related update: "), new), r"^[ |]+|[ |]+$", "")
    return F.when(new == "", old).otherwise(joined)


def overlap_score(query: Column, content: Column, keywords: Column, utility: Column) -> Column:
    """Distinct query tokens among the content's tokens, those among the keywords, and the utility."""
    q = tokens(query)
    return (F.size(F.array_intersect(q, tokens(content))) + F.size(F.array_intersect(q, lowered(keywords)))).cast("double") + utility


def answer(query: Column, contents: Column, keywords: Column) -> Column:
    """The answer from the selected notes' contents and keyword arrays, in order."""
    q = F.lower(query)
    per_note = F.zip_with(contents, keywords, lambda c, k: F.concat(pet_names(c), F.filter(lowered(k), lambda x: x.isin("buddy", "scout"))))
    dogs = F.array_distinct(F.flatten(per_note))
    name = F.try_element_at(F.filter(F.transform(contents, name_in), lambda x: x != ""), F.lit(1))
    has = lambda *words: F.greatest(*[q.contains(w) for w in words])
    return (
        F.when(has("dog", "pet"), F.when(F.size(dogs) > 0, F.concat(F.lit("You have two dogs: "), titled(dogs), F.lit("."))).otherwise(NO_DOGS))
        .when(has("job", "work", "career"), JOB_ANSWER)
        .when(has("name", "who am i"), F.when(name.isNotNull(), F.concat(F.lit("Your name is "), F.initcap(name), F.lit("."))).otherwise(NO_NAME))
        .otherwise(F.coalesce(F.try_element_at(contents, F.lit(1)), F.lit(NO_CONTEXT)))
    )


def summary(query: Column, reply: Column, reward: Column) -> Column:
    return F.concat(F.lit("Query: "), stripped(query), F.lit(" | Answer: "), stripped(reply), F.lit(" | Reward: "), reward.cast("string"))
