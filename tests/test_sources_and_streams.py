import json
import os
import random

import pytest
from pyspark.sql import functions as F

from engram import backends
from engram.operators import bank
from engram.operators.bank import Store
from engram.operators.construct import build_notes
from engram.profiling import StageTimes, stage_means
from engram.schema import NOTE, Params
from engram.sources import files
from engram.streaming.streams import ema_event_time, ema_stream, notes_sink


def test_jsonl_defaults_and_errors(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"id": "1", "query": "q", "history": ["a"]}\n\n   \n{"id": "2", "answer": "x"}\n')
    bad.write_text('{"id": "1"}\n{oops\n')
    got = {r["id"]: (r["query"], r["answer"], r["history"]) for r in files.read_jsonl(spark, str(good)).collect()}
    assert got == {"1": ("q", "", ["a"]), "2": ("", "x", [])}
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(bad)).collect()
    both = files.load_datasets(spark, dict.fromkeys(files.DATASETS, str(good)))
    assert both.groupBy("dataset").count().count() == 3


def test_last_prediction_wins(spark, tmp_path):
    p = tmp_path / "p.jsonl"
    p.write_text('{"id": 1, "prediction": "old"}\n{"id": 2, "prediction": "b"}\n{"id": 1, "prediction": "new"}\n')
    assert {r["id"]: r["prediction"] for r in files.read_predictions(spark, str(p)).collect()} == {"1": "new", "2": "b"}
    several = tmp_path / "several"
    several.mkdir()
    (several / "b.jsonl").write_text('{"id": 1, "prediction": "last"}\n')
    (several / "a.jsonl").write_text('{"id": 1, "prediction": "first"}\n' * 500)  # the larger file, which is read first or alone
    assert files.read_predictions(spark, str(several)).first()["prediction"] == "last"
    p.write_text('{"id": 1}\n')
    with pytest.raises(Exception):
        files.read_predictions(spark, str(p)).collect()


def test_results_round_trip(spark, tmp_path):
    from engram.operators.evaluation import results_json

    p = tmp_path / "r.json"
    p.write_text(json.dumps({"d/a": {"em": 0.5, "rougeL": 0.25}, "d/b": {"em": 1.0}}, indent=2))
    rows = files.read_results(spark, str(p))
    assert {tuple(r) for r in rows.collect()} == {("d/a", "em", 0.5), ("d/a", "rougeL", 0.25), ("d/b", "em", 1.0)}
    assert [r["json"] for r in results_json(rows).collect()] == ['{"d/a":{"em":0.5,"rougeL":0.25},"d/b":{"em":1.0}}']
    p.write_text(results_json(rows).first()["json"])
    assert files.read_results(spark, str(p)).count() == 3


def test_templates(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("Say {what}:\n{{json}} {what}")
    text = files.read_template(spark, str(p))
    assert spark.range(1).select(files.filled(text, what=F.lit("x")).alias("t")).first()["t"] == "Say x:\n{json} x"


def test_note_json_round_trip(spark):
    facts = spark.createDataFrame([("b", "n1", "I like apples.", 1)], "bank_id string, id string, content string, write_seq long").withColumn("ts", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    notes = build_notes(facts, Params(q0=0.25))
    back = files.notes_from_json(files.note_json(notes)).first()
    row = notes.first()
    assert all(back[c] == row[c] for c in ("id", "content", "ts", "keywords", "tags", "description", "embedding", "links", "intent", "utility"))
    least = spark.createDataFrame([('{"id": "a", "c": "x", "t": "2024-01-01T00:00:00"}',)], "json string")
    got = files.notes_from_json(least).first()
    assert (got["keywords"], got["links"], got["description"], got["embedding"], got["utility"]) == ([], [], "", [], 0.0)


def test_parameters():
    assert Params.from_json('{"lambda": 0.2, "k1": 7}') == Params(lam=0.2, k1=7)
    with pytest.raises(ValueError):
        Params.from_json('{"kk": 1}')


def test_backends(spark):
    def load():
        return (lambda prompts: [p.upper() for p in prompts]), (lambda texts: [[float(len(t))] for t in texts])

    b = backends.build("functions", load)
    rows = spark.createDataFrame([(1, "abc")], "id int, t string")
    assert rows.select(b.generate(F.col("t")).alias("x")).first()["x"] == "ABC"
    assert b.embed(rows, ["id"], F.col("t")).first()["embedding"] == [3.0]
    with pytest.raises(ValueError):
        backends.build("unknown")


def test_stage_times(spark):
    times = StageTimes()
    for name in ("write", "write", "read"):
        with times.stage(name):
            pass
    assert {r["stage"] for r in stage_means(times.frame(spark)).collect()} == {"write", "read"}


def test_ema_stream_equals_the_fold(spark, tmp_path):
    rows = [("a", 1, 1.0), ("a", 2, 0.0), ("b", 1, 1.0)]
    src = tmp_path / "in"
    spark.createDataFrame(rows, "key string, seq long, reward double").withColumn("ts", F.timestamp_seconds("seq")).write.parquet(str(src))
    stream = spark.readStream.schema("key string, seq long, reward double, ts timestamp").parquet(str(src))
    q = ema_stream(stream, 0.5, 0.0).writeStream.format("memory").queryName("ema_out").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["key"], r["steps"], r["utility"]) for r in spark.table("ema_out").collect()} == {("a", 2, 0.25), ("b", 1, 0.5)}


def test_notes_sink_writes_a_batch_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "bank"))
    facts = spark.createDataFrame([("b", "n1", "x", 0)], "bank_id string, id string, content string, write_seq long").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    batch, sink = build_notes(facts), notes_sink(store)
    sink(batch, 0)
    sink(batch, 0)
    assert store.versions() == [1] and store.load().columns == NOTE.names
    other = notes_sink(store, "other")
    other(batch.withColumn("id", F.lit("n2")), 0)  # batch 0 of a stream over a store that has a version
    other(batch.withColumn("id", F.lit("n3")), 0)
    assert sorted(r["id"] for r in store.load().collect()) == ["n1", "n2"]


def stored(spark, rows):
    """Notes (bank_id, id, content, utility) with all columns."""
    made = spark.createDataFrame([(*r, 1) for r in rows], "bank_id string, id string, content string, utility double, write_seq long")
    return made.select(*[(F.col(f.name) if f.name in made.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in NOTE])


def test_a_failed_save_does_not_lock_the_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "bank"))
    notes = stored(spark, [("b", "n1", "x", 0.5)])
    with pytest.raises(Exception):
        store.save(notes.withColumn("content", F.raise_error(F.lit("no")).cast("string")))
    assert store.versions() == [] and not list((tmp_path / "bank").rglob("*.parquet"))
    assert store.save(notes).count() == 1 and store.versions() == [1]


def test_a_write_makes_only_its_buckets_anew(spark, tmp_path):
    rows = [(b, f"n{i}", f"{b} {i}", i / 10) for b in ["a", "b", "c", "d", "e", None] for i in range(5)]
    store = Store(spark, str(tmp_path / "bank"), buckets=8)
    store.save(stored(spark, rows))
    first = store.manifest()
    store.upsert(stored(spark, [("c", "n1", "new", 0.9), ("c", "n9", "more", 0.1)]))
    second = store.manifest()
    changed = {k for k in first["folders"] if first["folders"][k] != second["folders"][k]}
    assert len(changed) == 1 and first["folders"].keys() == second["folders"].keys() and len(first["folders"]) > 2
    want = {(b, i): (t, q) for b, i, t, q in rows} | {("c", "n1"): ("new", 0.9), ("c", "n9"): ("more", 0.1)}
    assert {(r["bank_id"], r["id"]): (r["content"], r["utility"]) for r in store.load().collect()} == want
    assert {(r["bank_id"], r["id"]): r["content"] for r in store.load(1).collect()} == {(b, i): t for b, i, t, _ in rows}
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "bank" / "data").rglob("*.parquet")}
    gone = stored(spark, [("a", f"n{i}", None, None) for i in range(5)])
    store.change(gone, bank.delete)
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    assert store.load().where("bank_id = 'a'").count() == 0 and store.load().count() == len(want) - 5
    got = store.get("c", "n1", "n9", "none")
    assert sorted(r["content"] for r in got.collect()) == ["more", "new"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(id" in plan and len({f.split("bucket=")[1].split("/")[0] for f in got.inputFiles()}) == 1
    store.vacuum()
    assert store.versions() == [3] and store.load().count() == len(want) - 5
    with pytest.raises(ValueError):
        store.change(gone, lambda old, new: stored(spark, [(b, "n", "x", 0.0) for b in "abcde"]))


def test_of_two_writers_the_later_one_fails(spark, tmp_path):
    store, other = (Store(spark, str(tmp_path / "bank")) for _ in range(2))
    notes = stored(spark, [("b", "n1", "x", 0.5)])

    def slow(old, new):
        other.save(notes)
        return new

    with pytest.raises(Exception):
        store.change(notes, slow)
    assert store.versions() == [1] and not [p for p in (tmp_path / "bank" / "commits").iterdir() if p.name.startswith("_")]
    assert store.upsert(notes).count() == 1


def test_marks_of_streams_whose_names_begin_alike(spark, tmp_path):
    store = Store(spark, str(tmp_path / "bank"))
    notes_sink(store, "notes-2")(stored(spark, [("b", "n1", "x", 0.5)]), 7)
    assert store.mark("notes") is None and store.mark("notes-2") == 7
    notes_sink(store, "notes")(stored(spark, [("c", "n2", "y", 0.5)]), 0)
    assert (store.mark("notes"), store.mark("notes-2")) == (0, 7) and store.load().count() == 2


def test_ids_spread_one_bank_over_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "bank"), buckets=4, by=("bank_id", "id"))
    store.save(stored(spark, [("b", f"n{i}", "x", 0.5) for i in range(40)]))
    assert len(store.manifest()["folders"]) == 4
    again = Store(spark, str(tmp_path / "bank"))  # the table knows its own buckets
    again.upsert(stored(spark, [("b", "n3", "y", 0.5)]))
    assert again.load().count() == 40 and [r["content"] for r in again.get("b", "n3").collect()] == ["y"]


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_rewards_out_of_order_are_folded_by_event_time(spark, tmp_path):
    rng = random.Random(11)
    rows = [(rng.choice("abc"), i, rng.uniform(-1, 1), 1_700_000_000 + rng.randrange(20_000)) for i in range(300)]
    rows.sort(key=lambda r: r[3] + rng.uniform(0, 3000))  # at most an hour out of order
    rows += [("late", 900, 1.0, 1_700_000_500), ("a", 901, 1.0, 1_700_000_500), ("end", 999, 1.0, 1_700_090_000), ("end", 1000, 1.0, 1_700_990_000)]
    schema = "key string, seq long, reward double, s long"
    src = tmp_path / "in"
    for k in range(0, len(rows), 40):
        spark.createDataFrame(rows[k : k + 40], schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(str(src / f"{k:04d}"))
        for p in (src / f"{k:04d}").glob("*.parquet"):
            os.utime(p, (1_800_000_000 + k, 1_800_000_000 + k))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stream = spark.readStream.schema(f"{schema}, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    if "RocksDB" not in old:
        with pytest.raises(ValueError):
            ema_event_time(stream)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        made = ema_event_time(stream, "1 hour", 0.2, 0.5)
        q = made.writeStream.format("memory").queryName("ema_in_order").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        dropped = sum(o.numRowsDroppedByWatermark for p in q.recentProgress for o in p.stateOperators)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    last = {}
    for r in spark.table("ema_in_order").collect():
        last[r["key"]] = max(last.get(r["key"], (0, 0.0, 0)), (r["steps"], r["utility"], r["late"]))
    want = {}
    for key, _, reward, _ in sorted((r for r in rows if r[1] < 900), key=lambda r: (r[3], r[1])):
        n, u = want.get(key, (0, 0.5))
        want[key] = (n + 1, u + 0.2 * (reward - u))
    assert {k: v[:2] for k, v in last.items() if k in want} == {k: (n, pytest.approx(u)) for k, (n, u) in want.items()}
    assert dropped + sum(v[2] for v in last.values()) >= 1


def test_annotation_array_and_responses(spark, tmp_path):
    made = [("2", "q2", ["h"], "r", [("A", "x"), ("B", None)]), ("1", "q1", [], "s", [("B", 'y "z"')])]
    rows = spark.createDataFrame(made, files.ANNOTATION)
    path = tmp_path / "set.json"
    path.write_text(files.annotation_array(rows).first()["json"])
    back = files.read_annotations(spark, str(path))
    assert [(r["id"], r["query"], r["history"], r["reference"], [tuple(x) for x in r["systems"]]) for r in back.collect()] == [made[1], made[0]]
    given = spark.createDataFrame([("1", "B", 4.0), ("1", "A", 2.0)], "id string, label string, score double")
    assert {r["id"]: r["responses"] for r in files.responses(back, given).collect()} == {"1": {"A": 2.0, "B": 4.0}, "2": {}}
    assert files.annotation_array(rows.limit(0)).first()["json"] == "[]"
