"""Joins of versions do not go through the driver."""

from engram.operators import sequential

NOTES = "bank_id string, id string, write_seq long, keywords array<string>"
FACTS = "bank_id string, id string, seq long, keywords array<string>, is_query boolean"


def test_tables_of_a_row_a_fact_are_not_broadcast(spark):
    notes = spark.createDataFrame([("b", "n0", 0, ["k0"])], NOTES)
    facts = spark.createDataFrame([("b", f"f{i}", i, [f"k{i % 3}"], False) for i in range(12)], FACTS)
    made = sequential.decide_in_order(notes, facts)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    got = {r["id"]: (r["op"], r["note_id"]) for r in made.collect()}
    assert got == {f"f{i}": (("UPDATE", "n0") if i % 3 == 0 else ("ADD", f"f{i}") if i < 3 else ("UPDATE", f"f{i % 3}")) for i in range(12)}
