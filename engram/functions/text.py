"""Text functions as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the wording of a query's opening, whole words by letters of any script.
QUESTION = r"(?iU)^(what|who|where|when|how|which|do|does|is|are)\b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once a row, however often body names it: a plain Column would be copied into each
    place, and with it the passes over the text."""
    return F.transform(F.array(value), body)[0]


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalized(text: Column) -> Column:
    """Lower case, blanks collapsed, ends trimmed; null as empty."""
    return stripped(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def first_tokens(low: Column, n: int) -> Column:
    """The first n tokens of a lower-cased text, which is read as far as they go."""
    return tokens(F.regexp_extract(low, rf"^(?:[^a-z0-9]*+[a-z0-9]++){{0,{n}}}", 0))


def is_query(text: Column) -> Column:
    return text.contains("?") | F.rlike(stripped(text), F.lit(QUESTION))


def block_between(text: Column, start: str, end: str | None = None) -> Column:
    """What stands between two markers, trimmed: empty without the first, up to the end without the second."""
    at = F.locate(start, text)
    rest = F.substring(text, at + len(start), F.length(text))
    if end is not None:
        stop = F.locate(end, rest)
        rest = F.when(stop > 0, F.substring(rest, F.lit(1), stop - 1)).otherwise(rest)
    return F.when(at > 0, stripped(rest)).otherwise("")


def name_in(text: Column) -> Column:
    """The word after "name is", lower-cased, or empty."""
    return F.regexp_extract(F.lower(text), r"name is\s+([a-z]+)", 1)


def pet_names(text: Column) -> Column:
    """Words after "named"; without any, those of two known names that occur."""
    named = F.transform(F.regexp_extract_all(text, F.lit(r"named\s+([A-Za-z]+)"), F.lit(1)), F.lower)
    known = let(F.lower(text), lambda low: F.filter(F.array(*[F.when(low.contains(n), F.lit(n)) for n in ("buddy", "scout")]), lambda x: x.isNotNull()))
    return let(named, lambda found: F.array_distinct(F.when(F.size(found) > 0, found).otherwise(known)))


def embedding_text(content: Column, keywords: Column, tags: Column, description: Column) -> Column:
    return F.concat_ws(" ", content, F.array_join(keywords, " "), F.array_join(tags, " "), description)


def titled(names: Column) -> Column:
    return F.array_join(F.transform(names, F.initcap), ", ")
