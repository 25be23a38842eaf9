"""Readers and writers, held against SQL: what is written is read back and compared. Replies of the link stage, prompts, and single
scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.json_fields import evolve_reply, parse_relations
from engram.functions.vector import lcs_f
from engram.operators import bank as banks
from engram.operators import evaluation as ev
from engram.operators import payloads, postings
from engram.plans.learning_queries import ITEMS_SQL, RUNS_SQL, items, predictions, reward
from engram.plans.registry import query, table
from engram.plans.text_queries import NOTES_SQL, text_bank, turns
from engram.schema import NOTE
from engram.shared import fresh_path
from engram.sources.files import note_json, notes_from_json, read_annotations, read_jsonl, read_predictions, read_results, responses, write_annotations, write_jsonl


@query(f"WITH {ITEMS_SQL} SELECT conv_id::VARCHAR AS id, md5(query) AS query, md5(answer) AS answer, md5(coalesce(history, '')) AS history FROM items")
def jsonl_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "items")
    write_jsonl(items(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "query", "answer", "history"), path)
    return read_jsonl(spark, path).select("id", F.md5("query").alias("query"), F.md5("answer").alias("answer"), F.md5(F.array_join("history", "\n")).alias("history"))


@query(f"WITH {ITEMS_SQL} SELECT conv_id::VARCHAR AS id, md5(prediction) AS prediction FROM predictions WHERE system = 'full_context'")
def predictions_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "predictions")
    write_jsonl(predictions(spark, sf_dir).where("label = 'full_context'").select(F.col("id").cast("string").alias("id"), "prediction"), path)
    return read_predictions(spark, path).select("id", F.md5("prediction").alias("prediction"))


@query(f"WITH {RUNS_SQL} SELECT run, metric, round(value, 9) AS value FROM runs")
def results_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object of all runs, written and read again."""
    path, names = fresh_path(spark, "results"), F.array(*[F.lit(x) for x in ("em", "rougeL", "bertscore_f1", "other")])
    metric = F.element_at(names, (F.col("event_id") % 4 + 1).cast("int"))
    runs = table(spark, sf_dir, "events").groupBy(F.concat_ws("/", "event_type", "user_id").alias("run"), metric.alias("metric")).agg(F.avg(reward()).alias("value"))
    ev.results_json(runs).write.text(path)
    return read_results(spark, path).select("run", "metric", F.round("value", 9).alias("value"))


@query("""SELECT c_custkey::VARCHAR AS run, format('| {} | {:.4f} | {:.4f} | {:.4f} |', c_custkey, c_custkey % 16 / 16.0, c_custkey % 4 / 4.0, 0.0) AS line FROM customer""")
def results_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the Markdown table; a metric that a run lacks is 0."""
    k = F.col("c_custkey")
    metrics = F.array(F.struct(F.lit("em").alias("metric"), (k % 16 / 16.0).alias("value")), F.struct(F.lit("rougeL").alias("metric"), (k % 4 / 4.0).alias("value")))
    runs = table(spark, sf_dir, "customer").select(k.cast("string").alias("run"), F.explode(metrics).alias("m")).select("run", "m.metric", "m.value")
    return ev.results_table(runs).select("run", "line")


@query(f"""WITH {NOTES_SQL} SELECT bank_id::VARCHAR AS bank_id, id, md5(CASE WHEN write_seq = 1 THEN 'again ' || content ELSE content END) AS content, round(utility, 6) AS utility,
  CASE WHEN write_seq = 1 THEN 1001 ELSE write_seq END AS write_seq, 64 AS dim FROM notes""")
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the note table saved, the second with a rewritten note in each bank, and the latest one loaded; vectors of
    another length would fail."""
    vectors = {c: F.array_repeat(F.lit(0.125), 64) for c in ("embedding", "intent")}
    notes = text_bank(spark, sf_dir).withColumns(vectors | {"ts": F.lit("2024-01-01").cast("timestamp")})
    notes = notes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in NOTE])
    store = banks.Store(spark, fresh_path(spark, "store"))
    first = store.save(banks.checked_dim(notes, 64))
    again = first.where("write_seq = 1").withColumns({"content": F.concat(F.lit("again "), "content"), "write_seq": F.col("write_seq") + 1000})
    last = store.upsert(again)
    return last.select("bank_id", "id", F.md5("content").alias("content"), F.round("utility", 6).alias("utility"), "write_seq", F.size("embedding").alias("dim"))


@query(f"WITH {NOTES_SQL} SELECT bank_id::VARCHAR AS bank_id, id, md5(content) AS content, write_seq FROM notes WHERE bank_id = 7 AND write_seq IN (0, 3)")
def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes by id from a saved table: one bucket is read, filtered by its files' statistics and Bloom filters."""
    notes = turns(spark, sf_dir).select(F.col("bank_id").cast("string").alias("bank_id"), "id", "content", F.col("seq").cast("long").alias("write_seq"))
    store = banks.Store(spark, fresh_path(spark, "store"))
    store.save(notes.select(*[(F.col(f.name) if f.name in notes.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in NOTE]))
    return store.get("7", "7-0", "7-3", "7-none").select("bank_id", "id", F.md5("content").alias("content"), "write_seq")


@query("""SELECT event_id, CASE WHEN user_id % 4 = 0 THEN event_type || '>b:r,c>' || user_id || ':s' ELSE '' END AS relations FROM events""")
def relations_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with two relations, with none that names a note, with an empty list, and malformed."""
    u = F.col("user_id") % 4
    raw = (
        F.when(u == 0, F.concat(F.lit('[{"source": "'), "event_type", F.lit('", "target": "b", "relation": "r"}, {"source": "c", "target": "'), "user_id", F.lit('", "relation": "s"}]')))
        .when(u == 1, F.lit('[{"relation": "r"}]')).when(u == 2, F.lit("[]")).otherwise("[{")
    )
    shown = F.transform("r", lambda x: F.concat(x["source"], F.lit(">"), x["target"], F.lit(":"), x["relation"]))
    return table(spark, sf_dir, "events").select("event_id", parse_relations(raw).alias("r")).select("event_id", F.array_join(shown, ",").alias("relations"))


@query("""SELECT event_id, CASE user_id % 4 WHEN 0 THEN event_type || ',new' WHEN 3 THEN NULL ELSE 'old' END AS keywords, CASE user_id % 4 WHEN 3 THEN NULL ELSE 'tag' END AS tags,
  CASE user_id % 4 WHEN 1 THEN event_type WHEN 3 THEN NULL ELSE 'before' END AS description FROM events""")
def evolve_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with new keywords, with a new description, with no key, and malformed ones, which change nothing."""
    u, old = F.col("user_id") % 4, F.array(F.lit("old"))
    raw = (
        F.when(u == 0, F.concat(F.lit('{"keywords": ["'), "event_type", F.lit('", "new"]}'))).when(u == 1, F.concat(F.lit('{"description": "'), "event_type", F.lit('"}')))
        .when(u == 2, F.lit("{}")).otherwise("{broken")
    )
    made = table(spark, sf_dir, "events").select("event_id", evolve_reply(raw, old, F.array(F.lit("tag")), F.lit("before")).alias("f"))
    return made.select("event_id", F.array_join("f.keywords", ",").alias("keywords"), F.array_join("f.tags", ",").alias("tags"), "f.description")


@query(f"""WITH RECURSIVE {ITEMS_SQL},
toks AS (SELECT conv_id, system, regexp_extract_all(lower(prediction), '[a-z0-9]+') AS a, regexp_extract_all(lower(answer), '[a-z0-9]+') AS b FROM predictions JOIN items USING (conv_id)),
lcs AS (SELECT conv_id, system, 0 AS i, list_transform(b, lambda x: 0) AS best FROM toks
  UNION ALL SELECT conv_id, system, i + 1, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])) FROM (SELECT l.conv_id, l.system, i,
    list_transform(range(1, len(b) + 1), lambda j: greatest(best[j], CASE WHEN b[j] = a[i + 1] THEN coalesce(best[j - 1], 0) + 1 ELSE 0 END)) AS c
    FROM lcs l JOIN toks t ON t.conv_id = l.conv_id AND t.system = l.system WHERE i < len(a)))
SELECT conv_id AS id, system AS label, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 2.0 * best[-1] / (len(a) + len(b)) END, 9) AS score
FROM toks JOIN lcs USING (conv_id, system) WHERE i = len(a)""")
def rouge_l_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest common subsequence of each prediction and its reference, as F."""
    rows = predictions(spark, sf_dir).join(items(spark, sf_dir).select("id", "answer"), "id")
    return rows.select("id", "label", F.round(lcs_f(F.col("prediction"), F.col("answer")), 9).alias("score"))


@query("""SELECT c_custkey, '{"id":"' || c_custkey || '","keywords":["' || c_mktsegment || '"],"tags":[],"description":"' || c_name || '"}' AS short,
  '{"id":"' || c_custkey || '","keywords":["' || c_mktsegment || '"],"tags":[],"description":"' || c_name || '","content":null,"utility":' || (c_custkey % 4 / 4.0) || '}' AS long FROM customer""")
def note_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_custkey").cast("string").alias("id"), F.array("c_mktsegment").alias("keywords"), F.array().cast("array<string>").alias("tags"),
        F.col("c_name").alias("description"), F.lit(None).cast("string").alias("content"), (F.col("c_custkey") % 4 / 4.0).alias("utility"),
    )
    return notes.select("c_custkey", payloads.payload().alias("short"), payloads.payload(payloads.LONG).alias("long"))


@query("""SELECT conv_id AS query_id, md5('Q' || conv_id || chr(10) || coalesce(string_agg('- ' || text, chr(10) ORDER BY turn DESC) FILTER (turn BETWEEN 1 AND 3), '')) AS prompt FROM conversations GROUP BY conv_id""")
def baseline_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three turns of each conversation, the last first, as bullets; a shorter conversation has fewer or none."""
    t = turns(spark, sf_dir)
    asked = t.select(F.col("bank_id").alias("query_id")).distinct().withColumn("query", F.concat(F.lit("Q"), "query_id"))
    candidates = t.where("seq BETWEEN 1 AND 3").select(F.col("bank_id").alias("query_id"), (-F.col("seq")).alias("rank"), "content")
    return payloads.baseline_prompts(asked, candidates, "{query}\n{context}").select("query_id", F.md5("prompt").alias("prompt"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS written, epoch_us(ts) AS us FROM events""")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of notes in their JSON form, and read from it again."""
    e = table(spark, sf_dir, "events").withColumn("id", F.col("event_id").cast("string"))
    notes = e.select(*[(F.col(f.name) if f.name in ("id", "ts") else F.lit(None)).cast(f.dataType).alias(f.name) for f in NOTE])
    made = note_json(notes)
    back = notes_from_json(made.select("json")).select("id", F.unix_micros("ts").alias("us"))
    return made.select("id", F.get_json_object("json", "$.t").alias("written")).join(back, "id").select(F.col("id").cast("long").alias("event_id"), "written", "us")


@query("""SELECT conv_id, turn, sha256('{"bank_id":"' || conv_id || '","ts":null,"content":' || to_json(text) || ',"write_seq":' || turn || '}') AS id FROM conversations""")
def note_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that a fact has again whenever it is worked on again."""
    c = table(spark, sf_dir, "conversations")
    facts = c.select(F.col("conv_id").cast("string").alias("bank_id"), F.lit(None).cast("timestamp").alias("ts"), F.col("text").alias("content"), F.col("turn").alias("write_seq"), "conv_id", "turn")
    return payloads.with_ids(facts).select("conv_id", "turn", "id")


@query(f"""WITH {ITEMS_SQL} SELECT conv_id::VARCHAR AS id, md5(query) AS query, md5(coalesce(history, '')) AS history, md5(answer) AS reference, system AS label, md5(prediction) AS answer,
  row_number() OVER (PARTITION BY conv_id ORDER BY md5('42:' || conv_id || ':' || system)) AS place FROM items JOIN predictions USING (conv_id)""")
def annotation_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An annotation set as the JSON array that annotators load, written and read again."""
    path = fresh_path(spark, "annotations")
    made = ev.annotation_set(items(spark, sf_dir).withColumn("id", F.col("id").cast("string")), predictions(spark, sf_dir).withColumn("id", F.col("id").cast("string")))
    write_annotations(made, path)
    back = read_annotations(spark, path, lines=True).select("id", "query", "history", "reference", F.posexplode("systems").alias("at", "s"))
    return back.select("id", F.md5("query").alias("query"), F.md5(F.array_join("history", "\n")).alias("history"), F.md5("reference").alias("reference"), "s.label", F.md5("s.answer").alias("answer"), (F.col("at") + 1).cast("long").alias("place"))


@query(f"""WITH {ITEMS_SQL} SELECT conv_id AS id, label, (conv_id % 5 + len(label)) / 8.0::DOUBLE AS score FROM items, (SELECT unnest(['no_memory', 'full_context', 'last_history']) AS label) WHERE conv_id % 4 <> 0
UNION ALL SELECT conv_id, '', -1.0 FROM items WHERE conv_id % 4 = 0""")
def annotation_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of people joined to the items that they were shown; a quarter of the items has none."""
    made = ev.annotation_set(items(spark, sf_dir), predictions(spark, sf_dir))
    given = made.where("id % 4 <> 0").select("id", F.explode("systems.label").alias("label")).withColumn("score", (F.col("id") % 5 + F.length("label")) / 8.0)
    return responses(made, given).select("id", F.explode_outer("responses").alias("label", "score")).na.fill({"label": "", "score": -1.0})


@query("SELECT conv_id || '-' || turn AS id FROM conversations WHERE role = 'user' AND turn % 4 IN (0, 1)")
def postings_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same filter from a saved inverted index, of which the words asked for are read."""
    keyed = turns(spark, sf_dir).select("bank_id", "id", F.col("seq").alias("write_seq"), F.array(F.concat(F.lit("K"), F.col("seq") % 4)).alias("keywords"), F.array("role").alias("tags"))
    path = fresh_path(spark, "postings")
    postings.save(postings.build(keyed), path)
    return postings.matching(spark.read.parquet(path), keywords=["k0", "K1"], tags=["USER", "none"]).select("id")


@query("""SELECT kind, word, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (
  SELECT DISTINCT 'keywords' AS kind, lower(unnest(regexp_extract_all(text, '[A-Za-z]+')[1:2])) AS word, conv_id || '-' || turn AS id FROM conversations WHERE turn <> 1
  UNION ALL SELECT 'tags', role, conv_id || '-' || turn FROM conversations WHERE turn <> 1
  UNION ALL SELECT 'tags', 'changed', conv_id || '-' || turn FROM conversations WHERE turn = 1) GROUP BY ALL""")
def postings_after_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index after each bank's second note has been given another tag and no keyword."""
    words = F.slice(F.regexp_extract_all("content", F.lit("[A-Za-z]+"), F.lit(0)), 1, 2)
    notes = turns(spark, sf_dir).select("bank_id", "id", F.col("seq").alias("write_seq"), words.alias("keywords"), F.array("role").alias("tags"))
    changed = notes.where("write_seq = 1").withColumns({"keywords": F.array().cast("array<string>"), "tags": F.array(F.lit("Changed"))})
    after = postings.extended(postings.build(notes), changed)
    return after.groupBy("kind", "word").agg(F.max("n").alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))


@query("SELECT conv_id || '-' || turn AS id FROM conversations WHERE role = 'user' AND turn % 4 IN (0, 1)")
def attribute_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes tagged by role and keyed by the place of their turn, filtered by both."""
    keyed = turns(spark, sf_dir).withColumns({"keywords": F.array(F.concat(F.lit("K"), F.col("seq") % 4)), "tags": F.array("role")})
    return payloads.matching(keyed, keywords=["k0", "K1"], tags=["USER", "none"]).select("id")
