import math

import pytest
from pyspark.sql import functions as F

from engram.functions import json_fields as J
from engram.functions import text as T
from engram.functions.rules import answer, evolved_description, note_fields, overlap_score, summary
from engram.functions.vector import bucket, cosine, hash_embed, lcs_f, unit


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_")).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "expected"), [
    ("My name is Alex.", (["alex", "name", "identity"], ["profile", "personal"], "User's name is Alex.")),
    ("I adopted a dog named Buddy.", (["dog", "pet", "buddy"], ["pets"], "User has dog(s): Buddy.")),
    ("I work as a data scientist at a tech company.", (["job", "career", "data scientist"], ["career", "professional"], "User works as a data scientist at a tech company.")),
    ("  Plain words, plain facts here. ", (["plain", "words", "facts"], ["general"], "Plain words, plain facts here.")),
    ("...", (["general"], ["general"], "...")),
    ("A dog", (["dog", "pet"], ["pets"], "A dog")),
    ("My name is Kim and my dog is Scout", (["kim", "name", "identity", "dog", "pet", "scout"], ["profile", "personal", "pets"], "User has dog(s): Scout.")),
])
def test_note_fields(spark, text, expected):
    got = one(spark, note_fields(F.col("t")), t=text)
    k, g, x = expected
    assert (list(dict.fromkeys(got["keywords"])), got["tags"], got["description"]) == (k, g, x)


@pytest.mark.parametrize(("text", "expected"), [("What dogs do I have", True), ("My name is Alex.", False), ("really?", True), ("  is it", True), ("island", False)])
def test_is_query(spark, text, expected):
    assert one(spark, T.is_query(F.col("t")), t=text) is expected


def test_block_between(spark):
    text = F.col("t")
    assert one(spark, T.block_between(text, "A:", "B:"), t="A: x B: y") == "x"
    assert one(spark, T.block_between(text, "A:", "Z:"), t="A: x B: y") == "x B: y"
    assert one(spark, T.block_between(text, "Q:"), t="A: x") == ""


def test_normalized(spark):
    assert one(spark, T.normalized(F.col("t")), t="  A\t b\n C ") == "a b c"


def test_evolution_joins_descriptions(spark):
    d = evolved_description(F.col("a"), F.col("b"))
    assert one(spark, d, a="Old.", b="New.") == "Old. | Related update: New."
    assert one(spark, d, a="Old.", b=" ") == "Old."


def test_overlap_counts_distinct_tokens(spark):
    score = overlap_score(F.col("q"), F.col("c"), F.split("k", ","), F.lit(0.5))
    assert one(spark, score, q="what is my job job", c="my job is fun", k="job,data scientist") == 3 + 1 + 0.5


@pytest.mark.parametrize(("query", "expected"), [
    ("What dogs do I have?", "You have two dogs: Buddy, Scout."), ("What is my job?", "You work as a data scientist at a tech company."),
    ("What is my name?", "Your name is Alex."), ("Anything else", "my name is alex, dog named Buddy"),
])
def test_answers(spark, query, expected):
    contents = F.array(F.lit("my name is alex, dog named Buddy"), F.lit("scout"))
    keys = F.array(F.array(F.lit("x")), F.array(F.lit("Scout")))
    assert one(spark, answer(F.col("q"), contents, keys), q=query) == expected


def test_answers_without_notes(spark):
    none, nokeys = F.array().cast("array<string>"), F.array().cast("array<array<string>>")
    assert one(spark, answer(F.col("q"), none, nokeys), q="hm") == "I need more context."
    assert one(spark, answer(F.col("q"), none, nokeys), q="my name") == "I could not find your name in memory yet."


def test_summary(spark):
    assert one(spark, summary(F.col("q"), F.col("a"), F.lit(0.8)), q=" q ", a="a") == "Query: q | Answer: a | Reward: 0.8"


def test_parse_decision(spark):
    d = lambda raw: tuple(one(spark, J.parse_decision(F.col("r")), r=raw))
    assert d('{"op": "update", "target_id": "n1"}') == ("UPDATE", "n1")
    assert d('{"op": "ADD", "target_id": null}') == ("ADD", None)
    assert d('{"op": "ADD", "target_id": ""}') == ("ADD", None)
    assert d('{"op": "MERGE", "target_id": "n1"}') == (None, None)
    assert d("{") == (None, None)


def test_parse_fields_and_responses(spark):
    assert tuple(one(spark, J.parse_fields(F.col("r")), r="[1]")) == ([], [], "")
    assert tuple(one(spark, J.parse_fields(F.col("r")), r='{"keywords": ["a"]}')) == (["a"], [], "")
    assert one(spark, J.parse_response(F.col("r")), r='{"selected_ids": ["a"]}') is None
    assert tuple(one(spark, J.parse_response(F.col("r")), r='{"selected_ids": ["a"], "answer": "x"}')) == (["a"], "x")
    assert one(spark, J.parse_relations(F.col("r")), r='{"a": 1') == []
    assert len(one(spark, J.parse_relations(F.col("r")), r='[{"source": "a", "target": "b", "relation": "c"}]')) == 1


def test_evolve_reply_keeps_what_is_missing(spark):
    reply = J.evolve_reply(F.col("r"), F.array(F.lit("k")), F.array(F.lit("g")), F.lit("x"))
    assert tuple(one(spark, reply, r='{"keywords": ["n"]}')) == (["n"], ["g"], "x")
    assert one(spark, reply, r="{bad") is None


def test_hash_embedding_is_a_unit_vector(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id int, t string")
    got = {r["id"]: r["embedding"] for r in hash_embed(rows, ["id"], F.col("t")).collect()}
    assert all(math.isclose(sum(x * x for x in v), 1.0) for v in got.values())
    assert sorted(x for x in got[1] if x) == pytest.approx([1 / 5**0.5, 2 / 5**0.5])
    assert got[2] == got[3] and sum(x > 0 for x in got[2]) == 1
    assert one(spark, bucket(F.col("t")), t="abc") == 50


def test_cosine_of_zero(spark):
    assert one(spark, cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, unit(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, unit(F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx([0.6, 0.8])


def table_lcs(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
    return m[-1][-1]


def test_rouge_against_a_table(spark):
    pairs = [("the cat sat on the mat", "the cat lay on a mat"), ("a b c d", "d c b a"), ("", "x"), ("x", "x"), ("a a b a", "a b a a b")]
    got = [r["f"] for r in spark.createDataFrame(pairs, "p string, r string").coalesce(1).select(lcs_f(F.col("p"), F.col("r")).alias("f")).collect()]
    for (p, r), f in zip(pairs, got, strict=True):
        a, b = p.split(), r.split()
        assert f == pytest.approx(2 * table_lcs(a, b) / (len(a) + len(b)) if a and b else 0.0)


@pytest.mark.parametrize(("text", "expected"), [("Do it", True), ("  is", True), ("Do\u00edas de", False), ("do_it", False), ("x?", True), ("", False)])
def test_question_words_end_at_letters_of_any_script(spark, text, expected):
    assert one(spark, T.is_query(F.col("t")), t=text) is expected


@pytest.mark.parametrize("text", ["", "a", "One, two", "--a b  c-d e f", "\u212aelvin is hot today now", "\u4e2d\u6587", "x" * 100_000 + " y z", "-" * 100_000 + "y"])
def test_first_tokens(spark, text):
    import re

    assert one(spark, T.first_tokens(F.lower(F.col("t")), 4), t=text) == re.findall("[a-z0-9]+", text.lower())[:4]
