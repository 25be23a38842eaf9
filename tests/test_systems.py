from engram.functions.rules import BASELINE_ANSWER
from engram.operators.training import prompts, reward
from engram.plans.systems import SYSTEMS, evaluate, run_systems
from engram.schema import Params
from pyspark.sql import functions as F

ITEMS = "dataset string, id string, query string, answer string, history array<string>"


def test_every_system_on_every_item(spark):
    items = spark.createDataFrame([("d", "1", "What is my name?", "Your name is Alex.", ["Nothing to see.", "My name is Alex."]), ("e", "2", "x", None, None)], ITEMS)
    got = {(r["dataset"], r["system"]): r["prediction"] for r in run_systems(items, Params(delta=0.1)).collect()}
    assert len(got) == 2 * len(SYSTEMS)
    assert got["d", "full_system"] == got["d", "value_retrieval_only"] == "Your name is Alex."
    assert got["d", "atomic_linking"] == got["d", "write_ops_only"] == "My name is Alex."
    assert got["d", "full_context"] == "Nothing to see.\nMy name is Alex." and got["d", "sim_retrieval"] == ""
    assert got["e", "full_system"] == got["d", "no_memory"] == BASELINE_ANSWER


def test_runs_are_named_by_dataset_and_system(spark):
    items = spark.createDataFrame([("d", "1", "What is my name?", "your NAME is alex.", ["My name is Alex."])], ITEMS)
    got = {(r["run"], r["metric"]): r["value"] for r in evaluate(items, Params(delta=0.1)).collect()}
    assert got["d/full_system", "em"] == 1.0 and got["d/no_memory", "em"] == 0.0 and len(got) == 3 * len(SYSTEMS)


def test_training_prompts(spark):
    rows = spark.createDataFrame([("q?", [("n1", "c")], "Gold")], "query string, candidates array<struct<id string, content string>>, gold_answer string")
    row = prompts(rows).withColumn("r", reward(F.lit(" gold"), F.col("gold_answer"))).first()
    assert 'Query: q?\nCandidates: [{"id":"n1","content":"c"}]\n' in row["prompt"] and row["r"] == 1.0


def test_one_note_answers_as_a_replayed_bank_does(spark):
    from engram.operators.replay import Memory

    said = ["My name is Alex.", "I work as a scientist.", "I have a dog named Rex.", "tea and cake", "what is that?", ""]
    asks = ["What is my name?", "What is my job?", "Which dogs do I have?", "tea", "", "zebra"]
    rows = [("d", f"{i}-{j}", q, "", ["old", h]) for i, q in enumerate(asks) for j, h in enumerate(said)] + [("d", f"{i}", q, None, []) for i, q in enumerate(asks)]
    for delta in (0.0, 0.1, 0.5):
        p = Params(delta=delta)
        got = {r["id"]: r["prediction"] for r in run_systems(spark.createDataFrame(rows, ITEMS), p, ["value_retrieval_only"]).collect()}
        want = {}
        for _, i, q, _, history in rows:
            memory = Memory(p)
            if history:
                memory.put(memory.build("n0", history[-1]))
            want[i] = memory.answer(q)[1]
        assert got == want
