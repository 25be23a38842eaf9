from engram.operators import payloads, postings, write_ops
from pyspark.sql import functions as F

NOTES = [("a", "1", 1, ["Dog", "dog", "cat"], ["x"]), ("a", "2", 2, ["CAT"], ["X", "y"]), (None, "3", 3, ["dog", None], []), ("b", "4", 4, [], ["y"]), ("b", "5", 5, None, None)]
SCHEMA = "bank_id string, id string, write_seq long, keywords array<string>, tags array<string>"


def test_counts_and_filters(spark, tmp_path):
    notes = spark.createDataFrame(NOTES, SCHEMA)
    postings.save(postings.build(notes), str(tmp_path / "p"))
    index = spark.read.parquet(str(tmp_path / "p"))
    assert {(r["kind"], r["word"]): r["n"] for r in index.collect()} == {("keywords", "dog"): 2, ("keywords", "cat"): 2, ("tags", "x"): 2, ("tags", "y"): 2}
    for keywords, tags in ((["DOG"], []), ([], ["Y"]), (["cat", "dog"], ["x"]), (["dog"], ["y"]), (["none"], ["x"])):
        got = {r["id"] for r in postings.matching(index, keywords, tags).collect()}
        assert got == {r["id"] for r in payloads.matching(notes, keywords, tags).collect()}
    assert {r["id"] for r in postings.matching(index).collect()} == {"1", "2", "3", "4"}
    plan = postings.matching(index, ["dog"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(word,dog)" in plan or "In(word" in plan


def test_extended_equals_built_anew(spark):
    old = spark.createDataFrame(NOTES, SCHEMA)
    changed = spark.createDataFrame([(None, "3", 9, ["bird"], ["x"]), ("b", "6", 10, ["dog"], [])], SCHEMA)
    now = old.where("NOT (bank_id IS NULL AND id = '3')").unionByName(changed)
    assert sorted(map(repr, postings.extended(postings.build(old), changed).collect())) == sorted(map(repr, postings.build(now).collect()))


def test_decisions_read_postings(spark):
    index = postings.build(spark.createDataFrame(NOTES, SCHEMA))
    facts = spark.createDataFrame([(1, "A dog"), (2, "zebra crossing"), (3, "what?")], "fact_id long, content string")
    got = {r["fact_id"]: (r["op"], r["target_id"]) for r in write_ops.decide(facts, postings.bank_keywords(index)).collect()}
    assert got == {1: ("UPDATE", "1"), 2: ("ADD", None), 3: ("NOOP", None)}
    assert index.agg(F.count("*")).first()[0] == 8
