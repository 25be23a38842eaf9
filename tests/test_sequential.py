import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from engram.operators import sequential
from engram.operators.replay import replay
from engram.schema import Params

NOTE = "bank_id string, id string, content string, keywords array<string>, links array<string>, utility double, write_seq long"
FACT = "bank_id string, id string, seq long, content string, keywords array<string>, is_query boolean, links array<string>, utility double, write_seq long"


def random_banks(seed, banks, facts, words):
    """Notes and facts whose keywords meet again and again."""
    rng = random.Random(seed)
    few = lambda: [rng.choice(["", "A", "b"]) + f"k{min(rng.randrange(words), rng.randrange(words))}" for _ in range(rng.randint(0, 3))]
    notes = [(b, f"n{b}{i}", f"note {b} {i}", few(), [f"l{i}"], i / 10, i) for b in banks for i in range(rng.randint(0, 6))]
    made = [(b, f"f{b}{i}", i, f"fact {b} {i}", few(), rng.random() < 0.1, [], 0.5, None) for b in banks for i in range(rng.randint(0, facts))]
    rng.shuffle(made)
    return notes, made


def fold(notes, facts):
    """The writes one by one."""
    live, out = {}, {}
    for b, i, text, k, links, q, seq in sorted(notes, key=lambda n: n[6]):
        live.setdefault(b, []).append((i, {x.lower() for x in k}, text, links, q))
    for b, i, seq, text, k, query, links, q, _ in sorted(facts, key=lambda f: f[2]):
        mine, k = live.setdefault(b, []), {x.lower() for x in k}
        hit = next((n for n in mine if n[1] & k), None)
        if query:
            out[b, i] = ("NOOP", None)
        elif hit:
            mine.remove(hit)
            mine.append((hit[0], k, text, hit[3], hit[4]))
            out[b, i] = ("UPDATE", hit[0])
        else:
            mine.append((i, k, text, links, q))
            out[b, i] = ("ADD", i)
    return out, {b: [(n[0], n[2], n[3], n[4]) for n in v] for b, v in live.items() if v}


@pytest.mark.parametrize(("rounds", "words"), [(1, 5), (2, 12), (4, 40), (60, 6)])
def test_equals_the_fold(spark, rounds, words):
    notes, facts = random_banks(rounds, ["a", "b", None, "c", "d"], 30, words)
    decided, table = fold(notes, facts)
    old, new = spark.createDataFrame(notes, NOTE), spark.createDataFrame(facts, FACT).repartition(3)
    real, sequential.targets.__defaults__ = sequential.targets.__defaults__, (rounds,)
    try:
        got = {(r["bank_id"], r["id"]): (r["op"], r["note_id"]) for r in sequential.decide_in_order(old, new).collect()}
        after = sequential.write_in_order(old, new).orderBy("bank_id", "write_seq").collect()
    finally:
        sequential.targets.__defaults__ = real
    assert got == decided and {op for op, _ in got.values()} == {"ADD", "UPDATE", "NOOP"}
    banks = {}
    for r in after:
        banks.setdefault(r["bank_id"], []).append((r["id"], r["content"], r["links"], r["utility"]))
    assert banks == table


def test_equals_replay_of_contents(spark):
    rng = random.Random(9)
    say = ["My name is Alex.", "I adopted a dog named Buddy.", "I work as a scientist.", "Scout is a dog too.", "apples and pears", "pears again today", "What now?", "red blue", "blue green", "my job and my dog"]
    turns = [(b, i, rng.choice(say), None, None) for b in "xyz" for i in range(25)]
    rows = spark.createDataFrame(turns, "bank_id string, turn long, content string, query string, reward double")
    want = {(r["bank_id"], r["turn"]): (r["op"], r["note_id"]) for r in replay(rows, replace(Params(), link=False)).collect()}
    facts = sequential.facts_of(rows.select("bank_id", F.concat(F.lit("n"), "turn").alias("id"), F.col("turn").alias("seq"), "content"))
    none = spark.createDataFrame([], NOTE)
    got = {(r["bank_id"], r["seq"]): (r["op"], r["note_id"]) for r in sequential.decide_in_order(none, facts).collect()}
    assert got == want


def test_a_chain_on_one_keyword_needs_no_fold(spark, monkeypatch):
    monkeypatch.setattr(sequential, "_rest", lambda *_: pytest.fail("folded"))
    facts = [("b", f"f{i:03d}", i, "x", ["same"], False, [], 0.5, None) for i in range(200)]
    for held in (0, 3):
        notes = spark.createDataFrame([("b", f"n{i}", "x", ["Same"], [], 0.5, i) for i in range(held)], NOTE)
        got = {r["id"]: (r["op"], r["note_id"]) for r in sequential.decide_in_order(notes, spark.createDataFrame(facts, FACT)).collect()}
        want = {f"f{i:03d}": ("UPDATE", f"n{i % held}") if held else ("UPDATE" if i else "ADD", "f000") for i in range(200)}
        assert got == want


def test_nothing_to_write(spark):
    none, facts = spark.createDataFrame([], NOTE), spark.createDataFrame([], FACT)
    notes = spark.createDataFrame(random_banks(3, ["a"], 0, 5)[0], NOTE)
    assert sequential.decide_in_order(none, facts).collect() == []
    assert sorted(sequential.write_in_order(notes, facts).collect()) == sorted(notes.collect())
