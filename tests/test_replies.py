import json
import os

import pytest
from pyspark.sql import functions as F

from engram import backends
from engram.functions.json_fields import parse_decision, parse_fields, parse_relations, parse_response
from engram.operators import replies


def replied(spark, prompt):
    return spark.createDataFrame([(prompt,)], "p string").select(backends.rules().generate(F.col("p")).alias("r")).first()["r"]


def test_each_stage_has_its_rules(spark):
    note = json.loads(replied(spark, "STAGE=NOTE\nCONTENT: My name is Alex. I have a dog named Rex. "))
    assert note == {"keywords": ["alex", "name", "identity", "dog", "pet", "rex"], "tags": ["profile", "personal", "pets"], "description": "User has dog(s): Rex."}
    memory = json.dumps([{"id": "a", "keywords": ["job"]}, {"id": "b", "keywords": ["DOG"]}, {"id": "c", "keywords": ["dog"]}])
    assert json.loads(replied(spark, f"STAGE=WRITE_OP\nCONTENT: a dog\nMEMORY: {memory}")) == {"op": "UPDATE", "target_id": "b"}
    assert json.loads(replied(spark, f"STAGE=WRITE_OP\nCONTENT: apples\nMEMORY: {memory}")) == {"op": "ADD", "target_id": None}
    assert json.loads(replied(spark, f"STAGE=WRITE_OP\nCONTENT: what dog\nMEMORY: {memory}")) == {"op": "NOOP", "target_id": None}
    assert json.loads(replied(spark, "STAGE=WRITE_OP\nCONTENT: a dog\nMEMORY: no list")) == {"op": "ADD", "target_id": None}
    near = json.dumps([{"id": "n", "tags": ["x"]}, {"id": "p", "tags": ["X"]}, {"tags": []}, {"id": "q"}, {"id": "r", "tags": ["x"]}])
    got = json.loads(replied(spark, f'STAGE=LINK\nNEW_NOTE: {{"id": "n", "tags": ["x"]}}\nNEIGHBORS: {near}'))
    assert got == [{"source": "n", "target": "p", "relation": "same-domain"}, {"source": "n", "target": "q", "relation": "semantic-related"}]
    got = json.loads(replied(spark, 'STAGE=EVOLVE\nEXISTING_NOTE: {"keywords": ["a"], "description": "old"}\nNEW_NOTE: {"keywords": ["b", "a"], "tags": ["t"], "description": "new"}'))
    assert got == {"keywords": ["a", "b"], "tags": ["t"], "description": "old | Related update: new"}
    notes = json.dumps([{"id": "1", "content": "I like tea", "keywords": ["tea"]}, {"id": "2", "content": "My name is Ann", "keywords": [], "utility": 0.5}, {"id": "3", "content": "x"}])
    assert json.loads(replied(spark, f"STAGE=ANSWER\nQUERY: what is my name?\nCANDIDATES: {notes}")) == {"selected_ids": ["2", "1"], "answer": "Your name is Ann."}
    assert json.loads(replied(spark, "STAGE=ANSWER\nQUERY: tea\nCANDIDATES: []")) == {"selected_ids": [], "answer": "I need more context."}
    assert replied(spark, "STAGE=SUMMARY\nQUERY: q \nANSWER: a\nREWARD: 0.5\n") == "Query: q | Answer: a | Reward: 0.5"
    assert replied(spark, "STAGE=BASELINE").startswith("I do not have") and replied(spark, "STAGE=OTHER") == replied(spark, "") == "{}" and replied(spark, None) is None


def test_replies_are_what_the_parsers_read(spark):
    prompts = ["STAGE=NOTE\nCONTENT: tea and cake", 'STAGE=WRITE_OP\nCONTENT: tea\nMEMORY: [{"id": "a", "keywords": ["tea"]}]', 'STAGE=LINK\nNEW_NOTE: {"id": "n"}\nNEIGHBORS: [{"id": "m"}]',
               'STAGE=ANSWER\nQUERY: tea\nCANDIDATES: [{"id": "a", "content": "tea"}]']
    rows = spark.createDataFrame([(p,) for p in prompts], "p string").coalesce(1).withColumn("r", backends.rules().generate(F.col("p")))
    r = F.col("r")
    got = rows.select(parse_fields(r).alias("f"), parse_decision(r).alias("d"), parse_relations(r).alias("l"), parse_response(r).alias("a")).collect()
    assert got[0]["f"]["keywords"] == ["tea", "and", "cake"] and (got[1]["d"]["op"], got[1]["d"]["target_id"]) == ("UPDATE", "a")
    assert [tuple(x) for x in got[2]["l"]] == [("n", "m", "semantic-related")] and got[3]["a"]["selected_ids"] == ["a"]


def test_no_prompt_is_asked_twice_and_nothing_answered_is_lost(spark, tmp_path):
    log, path = str(tmp_path / "log"), str(tmp_path / "kept")
    os.mkdir(log)
    prompts = spark.createDataFrame([(i, f"prompt {i % 30}" if i != 7 else None) for i in range(90)], "id long, prompt string").repartition(4)

    def load(broken):
        def make():
            def generate(texts):
                if broken and any(t.endswith("3") for t in texts):
                    raise OSError("away")
                for t in texts:
                    with open(f"{log}/{t}", "a") as f:
                        f.write("x")
                return [t.upper() for t in texts]

            return generate

        return make

    with pytest.raises(RuntimeError, match="3 prompts have no reply.*away"):
        replies.ask(prompts, load(True), path, rounds=2, at_once=1)
    some = replies.ask(prompts, load(True), path, at_once=1, strict=False)
    assert some.where("reply IS NULL").count() == 9 + 1
    whole = replies.ask(prompts, load(False), path, at_once=5)
    assert {(r["id"], r["prompt"], r["reply"]) for r in whole.collect()} == {(i, f"prompt {i % 30}" if i != 7 else None, f"PROMPT {i % 30}" if i != 7 else None) for i in range(90)}
    assert len(os.listdir(log)) == 30 and all(os.path.getsize(f"{log}/{f}") == 1 for f in os.listdir(log))


def test_replies_of_the_wrong_number_and_no_prompts(spark, tmp_path):
    prompts = spark.createDataFrame([("a",)], "prompt string")
    with pytest.raises(RuntimeError, match="0 replies to 1 prompts"):
        replies.ask(prompts, lambda: lambda texts: [], str(tmp_path / "a"))
    assert replies.ask(prompts.where("false"), lambda: lambda texts: [], str(tmp_path / "b")).collect() == []
