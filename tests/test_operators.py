import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from engram.operators import bank, link, payloads, retrieve, utility, write_ops
from engram.operators import evaluation as ev
from engram.operators.construct import build_notes
from engram.operators.knn import knn
from engram.operators.replay import replay
from engram.schema import Params

NOTES = "bank_id string, id string, content string, links array<string>, utility double, write_seq long"


def notes(spark, *rows):
    return spark.createDataFrame([("b", *r) for r in rows], NOTES)


def vectors(spark, *rows):
    return spark.createDataFrame(list(rows), "vec_id long, embedding array<double>, utility double")


def test_similarity_floor_keeps_the_aligned_note(spark):
    b = vectors(spark, (1, [1.0, 0.0], 0.1), (2, [0.0, 1.0], 0.9))
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>")
    got = retrieve.hybrid_retrieve(q, b, Params(k1=2, k2=1, delta=0.9, lam=0.5)).collect()
    assert [r["vec_id"] for r in got] == [1]


def test_utility_outweighs_similarity(spark):
    b = vectors(spark, (1, [1.0, 0.0], 0.1), (2, [0.5, 0.5], 0.9))
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>")
    got = retrieve.hybrid_retrieve(q, b, Params(k1=2, k2=2, delta=0.0, lam=0.7)).orderBy("place").collect()
    assert [(r["vec_id"], round(r["score"], 6)) for r in got] == [(2, 0.4), (1, -0.4)]


def test_knn_ties_zero_vectors_and_small_banks(spark):
    b = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (4, None)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (9, [0.0, 0.0])], "query_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["sim"]) for r in knn(q, b, 10).collect()}
    assert [got[0, k] for k in (1, 2, 3)] == [(1, 1.0), (3, 1.0), (2, 0.0)]
    assert [got[9, k][0] for k in (1, 2, 3)] == [1, 2, 3] and len(got) == 6
    assert knn(q, b.where("vec_id > 9"), 3).count() == 0


def test_zscore_of_equal_values_is_zero(spark):
    rows = spark.createDataFrame([(1, 0.1), (1, 0.1), (1, 0.1), (2, 5.0)], "g int, x double")
    assert {r["z"] for r in rows.select(retrieve.zscore("x", "g").alias("z")).collect()} == {0.0}


def test_distil_fallbacks(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long")
    pool = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (3, "a", 1)], "query_id long, id string, place int")
    replies = spark.createDataFrame([(1, '{"selected_ids": ["b"], "answer": "x"}'), (2, "nope"), (3, '{"selected_ids": [], "answer": "y"}')], "query_id long, reply string")
    got = {r["query_id"]: (r["ids"], r["answer"]) for r in retrieve.distil_and_answer(queries, pool, replies, F.lit("base")).collect()}
    assert got == {1: (["b"], "x"), 2: (["a"], "base"), 3: (["a"], "y"), 4: ([], "base")}


def test_ema_after_ten_rewards(spark):
    rows = spark.createDataFrame([("n1", i, 1.0) for i in range(10)], "key string, seq long, reward double").withColumn("ts", F.timestamp_seconds(F.col("seq") * 40_000))
    got = utility.ema(rows, 0.1, 0.0).first()
    assert got["steps"] == 10 and got["utility"] == pytest.approx(1 - 0.9**10)


def test_ema_equals_the_ordered_fold(spark):
    rng = random.Random(5)
    data = [(rng.choice("abc"), rng.randint(0, 400_000), i, rng.uniform(-1, 1)) for i in range(400)]
    rows = spark.createDataFrame(data, "key string, s long, seq long, reward double").withColumn("ts", F.timestamp_seconds("s"))
    q, n, path = {}, {}, {}
    for key, _, seq, r in sorted(data, key=lambda x: (x[1], x[2])):
        q[key] = q.get(key, 0.5) + 0.2 * (r - q.get(key, 0.5))
        n[key] = n.get(key, 0) + 1
        path[seq] = (key, n[key], q[key])
    assert {r["key"]: pytest.approx(r["utility"]) for r in utility.ema(rows, 0.2).collect()} == q
    got = {r["seq"]: (r["key"], r["step"], r["utility"]) for r in utility.ema_trajectory(rows, 0.2).collect()}
    assert got.keys() == path.keys() and all(got[s][:2] == path[s][:2] and got[s][2] == pytest.approx(path[s][2]) for s in path)


def test_upsert_is_idempotent_and_moves_rows_last(spark):
    table = notes(spark, ("a", "x", [], 0.5, 1), ("b", "y", [], 0.5, 2), ("c", "z", [], 0.5, 3))
    write = bank.numbered(table, notes(spark, ("a", "new", [], 0.1, 0)), [F.col("id")]).select(*table.columns)
    once = bank.upsert(table, write)
    assert [r["id"] for r in bank.list_notes(once).collect()] == ["b", "c", "a"]
    assert sorted(bank.upsert(once, write).collect()) == sorted(once.collect())


def test_patch_delete_lookup_and_merge(spark):
    table = notes(spark, ("a", "x", ["b"], 0.5, 1), ("b", "y", ["a"], 0.9, 2))
    delta = spark.createDataFrame([("b", "a", 7, 0.75), ("b", "none", 8, 0.1)], "bank_id string, id string, write_seq long, utility double")
    assert {r["id"]: (r["content"], r["utility"], r["write_seq"]) for r in bank.patch(table, delta).collect()} == {"a": ("x", 0.75, 7), "b": ("y", 0.9, 2)}
    left = bank.delete(table, table.where("id = 'b'"))
    assert [tuple(r) for r in bank.dangling_links(left).collect()] == [("b", "a", "b")]
    asked = spark.createDataFrame([("b", ["b", "zz", "a"])], "bank_id string, ids array<string>")
    assert [(r["id"], r["position"]) for r in bank.get_notes(table, asked).orderBy("position").collect()] == [("b", 0), ("a", 2)]
    new = notes(spark, ("n", "new", [], 0.5, 3), ("m", "new", [], 0.5, 4)).withColumn("target_id", F.when(F.col("id") == "n", "b"))
    assert {(r["id"], r["content"], tuple(r["links"]), r["utility"]) for r in bank.merge_update(table, new).collect()} == {("b", "new", ("a",), 0.9), ("m", "new", (), 0.5)}


def test_store_keeps_versions(spark, tmp_path):
    store = bank.Store(spark, str(tmp_path / "bank"))
    assert store.load().count() == 0
    facts = spark.createDataFrame([("b", "n1", "I like apples.", 1)], "bank_id string, id string, content string, write_seq long").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    built = build_notes(facts)
    store.save(built)
    again = store.save(bank.upsert(store.load(), built))
    row = again.first()
    assert store.versions() == [1, 2] and again.count() == 1
    assert (row["keywords"], row["tags"], row["utility"], row["links"], len(row["embedding"]), len(row["intent"])) == (["i", "like", "apples"], ["general"], 0.5, [], 64, 64)


def test_links_are_symmetric_and_keep_old_ones(spark):
    near = spark.createDataFrame([("n", "n", 1, ["t"], ["t"]), ("n", "x", 2, ["T"], ["t"]), ("n", "y", 3, ["t"], ["u"]), ("n", "z", 4, ["t"], ["t"])], "src string, dst string, rank int, src_tags array<string>, dst_tags array<string>")
    found = link.relations(near)
    assert {tuple(r) for r in found.collect()} == {("n", "x", "same-domain"), ("n", "y", "semantic-related")}
    edges = link.link_edges(link.accepted(found, near))
    pairs = {(r["src"], r["dst"]) for r in edges.collect()}
    assert pairs == {("n", "x"), ("x", "n"), ("n", "y"), ("y", "n")}
    table = notes(spark, ("n", "", ["old", "x"], 0.5, 1), ("x", "", None, 0.5, 2))
    assert {r["id"]: r["links"] for r in link.add_links(table, edges).collect()} == {"n": ["old", "x", "y"], "x": ["n"]}
    start = spark.createDataFrame([("x",)], "id string")
    assert {(r["id"], r["hop"]) for r in link.hops(edges, start, 2).collect()} == {("x", 0), ("n", 1), ("y", 2)}


def test_write_decisions(spark):
    facts = spark.createDataFrame([(1, "What is it"), (2, "My dog Rex"), (3, "Zebra crossing")], "fact_id long, content string")
    keys = spark.createDataFrame([("n2", 2, "DOG"), ("n1", 1, "pet"), ("n3", 3, "dog")], "id string, write_seq long, keyword string")
    got = {r["fact_id"]: (r["op"], r["target_id"]) for r in write_ops.decide(facts, keys).collect()}
    assert got == {1: ("NOOP", None), 2: ("UPDATE", "n1"), 3: ("ADD", None)}


def test_replayed_demo(spark):
    facts = ["My name is Alex.", "I adopted a dog named Buddy.", "I also adopted another dog named Scout.", "I work as a data scientist at a tech company."]
    asks = ["What dogs do I have?", "What is my job?", "What is my name?"]
    rows = [("b", i, f, None, None) for i, f in enumerate(facts)] + [("b", 10 + i, None, q, 0.8) for i, q in enumerate(asks)]
    turns = spark.createDataFrame(rows, "bank_id string, turn long, content string, query string, reward double")
    got = replay(turns, replace(Params(), delta=0.1)).orderBy("turn").collect()
    assert [r["op"] for r in got[:3]] == ["ADD", "ADD", "UPDATE"] and got[2]["note_id"] == "n1"
    assert got[5]["answer"] == "You work as a data scientist at a tech company."


def test_five_turns_make_ten_notes(spark):
    words = ["alpha", "bravo", "carol", "delta", "ether"]
    rows = [("b", i, f"{w} {w}x {w}y", f"{w} {w}x", 1.0) for i, w in enumerate(words)]
    turns = spark.createDataFrame(rows, "bank_id string, turn long, content string, query string, reward double")
    got = replay(turns, replace(Params(), link=False, delta=0.2)).orderBy("turn").collect()
    assert [r["op"] for r in got] == ["ADD"] * 5 and got[-1]["notes"] == 10


def test_metrics_and_tables(spark):
    rows = spark.createDataFrame([("s", "A  b", "a b"), ("s", "x", "y")], "system string, prediction string, reference string")
    got = ev.compute_metrics(rows, by=("system",)).first()
    assert got["em"] == 0.5 and got["rougeL"] == 0.5 and 0.5 <= got["bertscore_f1"] <= 1.0
    assert ev.compute_metrics(rows.limit(0), ["em"]).first()["em"] == 0.0
    with pytest.raises(ValueError):
        ev.compute_metrics(rows, ["bleu"])
    results = spark.createDataFrame([("d/b", "em", 0.25), ("d/a", "rougeL", 1.0), ("d/a", "extra", 1.0)], "run string, metric string, value double")
    assert [r["line"] for r in ev.results_table(results).collect()] == ["| d/a | 0.0000 | 1.0000 | 0.0000 |", "| d/b | 0.2500 | 0.0000 | 0.0000 |"]


def test_annotation_set_hides_the_order(spark):
    items = spark.createDataFrame([(str(i), "q", "a", ["h"]) for i in range(40)], "id string, query string, answer string, history array<string>")
    preds = spark.createDataFrame([(s, str(i), f"{s}{i}") for i in range(39) for s in "xy"], "label string, id string, prediction string")
    got = {r["id"]: [(s["label"], s["answer"]) for s in r["systems"]] for r in ev.annotation_set(items, preds).collect()}
    assert sorted(got["39"]) == [("x", ""), ("y", "")] and {v[0][0] for v in got.values()} == {"x", "y"}
    assert got == {r["id"]: [(s["label"], s["answer"]) for s in r["systems"]] for r in ev.annotation_set(items, preds).collect()}


def test_group_advantage(spark):
    rows = spark.createDataFrame([(1, 0.0), (1, 2.0), (2, 5.0)], "g int, r double")
    assert sorted((r["g"], r["advantage"]) for r in utility.group_advantage(rows, "g", "r").collect()) == [(1, -1.0), (1, 1.0), (2, 0.0)]


def test_write_path_applies_each_operation(spark):
    bank_notes = notes(spark, ("a", "A", ["x"], 0.9, 1), ("b", "B", ["y"], 0.8, 2))
    facts = spark.createDataFrame([
        ("b", "n1", "one", [], 0.5, 11, '{"op": "add"}'),
        ("b", "n2", "two", [], 0.5, 12, '{"op": "update", "target_id": "a"}'),
        ("b", "n3", "three", [], 0.5, 13, "no reply"),
        ("b", "n4", "four", [], 0.5, 14, '{"op": "DELETE", "target_id": "b"}'),
        ("b", "n5", "five", [], 0.5, 15, '{"op": "DELETE", "target_id": "unknown"}'),
        ("b", "n6", "six", [], 0.5, 16, '{"op": "NOOP", "target_id": "a"}'),
        ("b", "n7", "seven", [], 0.5, 17, '{"op": "UPDATE"}'),
        ("empty", "n8", "eight", [], 0.5, 18, None),
    ], NOTES + ", reply string")
    got = {r["id"]: (r["bank_id"], r["content"], r["links"], r["utility"], r["write_seq"]) for r in write_ops.write_path(bank_notes, facts).collect()}
    assert got == {
        "a": ("b", "three", ["x"], 0.9, 13), "n1": ("b", "one", [], 0.5, 11),
        "n7": ("b", "seven", [], 0.5, 17), "n8": ("empty", "eight", [], 0.5, 18),
    }


def test_write_path_without_facts_or_notes(spark):
    some, none = notes(spark, ("a", "A", [], 0.9, 1)), notes(spark)
    assert write_ops.write_path(some, none.withColumn("reply", F.lit("x"))).collect() == some.collect()
    assert [r["id"] for r in write_ops.write_path(none, some.withColumn("reply", F.lit('{"op": "DELETE", "target_id": "a"}'))).collect()] == []


def test_consolidation_skips_turns_without_an_answer(spark):
    rows = [("b", "s1", " who? ", "you ", 1.0, None, 1), ("b", "s2", "q", None, 1.0, None, 2), ("b", "s3", "q", "a", None, None, 3)]
    answered = spark.createDataFrame(rows, "bank_id string, id string, query string, answer string, reward double, ts timestamp, write_seq long")
    got = write_ops.consolidate(answered).collect()
    assert [(r["id"], r["content"], r["utility"], r["links"]) for r in got] == [("s1", "Query: who? | Answer: you | Reward: 1.0", 0.5, [])]


def test_prompts_of_notes(spark):
    queries = spark.createDataFrame([(1, "q"), (2, "r")], "query_id long, query string")
    found = spark.createDataFrame([(1, 2, "b", ["k"], [], "d", "B", 0.5), (1, 1, "a", [], [], "", None, 1.0)],
                                  "query_id long, rank int, id string, keywords array<string>, tags array<string>, description string, content string, utility double")
    got = {r["query_id"]: r["prompt"] for r in payloads.answer_prompts(queries, found, "{query}:{notes}").collect()}
    assert got[2] == "r:[]"
    assert got[1] == 'q:[{"id":"a","keywords":[],"tags":[],"description":"","content":null,"utility":1.0},{"id":"b","keywords":["k"],"tags":[],"description":"d","content":"B","utility":0.5}]'
    bullets = {r["query_id"]: r["prompt"] for r in payloads.baseline_prompts(queries, found, "{query}|{context}").collect()}
    assert bullets == {1: "q|- \n- B", 2: "r|"}


def test_ids_repeat(spark):
    facts = spark.createDataFrame([("b", "x", None, 1), ("b", None, None, 1), (None, "x", None, 1)], "bank_id string, content string, ts timestamp, write_seq long")
    first, second = ([r["id"] for r in payloads.with_ids(facts).collect()] for _ in range(2))
    assert first == second and len(set(first)) == 3


def test_knn_keeps_lengths_apart(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = knn(rows.withColumnRenamed("vec_id", "query_id"), rows, 2)
    assert sorted((r["query_id"], r["vec_id"]) for r in got.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]


def test_trajectory_of_a_key_with_many_rewards_and_steep_weights(spark):
    rng = random.Random(8)
    for alpha, n in ((0.1, 3000), (0.9, 700), (0.999999, 300), (1.0, 50), (0.001, 2000)):
        data = [("k" if i % 3 else None, rng.randrange(4_000_000), i, rng.uniform(-1, 1)) for i in range(n)] + [("k", 5, n, None)]
        rows = spark.createDataFrame(data, "key string, s long, seq long, reward double").withColumn("ts", F.timestamp_seconds("s"))
        q, steps, path = {}, {}, {}
        for key, _, seq, r in sorted((d for d in data if d[3] is not None), key=lambda x: (x[1], x[2])):
            q[key] = q.get(key, 0.5) + alpha * (r - q.get(key, 0.5))
            steps[key] = steps.get(key, 0) + 1
            path[seq] = (key, steps[key], q[key])
        got = {r["seq"]: (r["key"], r["step"], r["utility"]) for r in utility.ema_trajectory(rows, alpha, span="week").collect()}
        assert got.keys() == path.keys() and all(got[s][:2] == path[s][:2] and got[s][2] == pytest.approx(path[s][2], abs=1e-12) for s in path)


def test_advantage_of_rows_without_a_group(spark):
    rows = spark.createDataFrame([(1, 0.0), (None, 2.0), (None, 4.0)], "g int, r double")
    assert sorted((r["r"], r["advantage"]) for r in utility.group_advantage(rows, "g", "r").collect()) == [(0.0, 0.0), (2.0, -1.0), (4.0, 1.0)]


def test_longest_common_subsequence_equals_the_table(spark):
    from engram.functions.vector import lcs_length

    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcdefg"[: rng.randint(1, 7)]) for _ in range(rng.randint(0, 150))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert lcs_length(a, b) == table[-1][-1]
