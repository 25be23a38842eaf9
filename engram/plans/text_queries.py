"""Text functions, model replies, write decisions and the note table, over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.functions import text as T
from engram.functions.json_fields import parse_decision, parse_fields
from engram.functions.rules import note_fields
from engram.functions.vector import hash_buckets, hash_weights
from engram.operators import bank as banks
from engram.operators import write_ops
from engram.plans.registry import query, table
from engram.plans.vector_queries import FIELDS_SQL
from engram.sources.files import filled, note_json, notes_from_json

#: Fixed value: the wording of a query's opening.
QUESTION_SQL = r"(contains({0}, '?') OR regexp_matches(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '^(what|who|where|when|how|which|do|does|is|are)([^\pL\pN_]|$)', 'i'))"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as facts: (bank_id, id, seq, content, role)."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("bank_id"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("turn").alias("seq"), F.col("text").alias("content"), "role")


@query(f"SELECT doc_id, {QUESTION_SQL.format('text')} AS is_query FROM documents")
def query_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.is_query(F.col("text")).alias("is_query"))


@query(f"SELECT CASE WHEN {QUESTION_SQL.format('text')} THEN 'read' ELSE 'write' END AS path, count(*) AS n FROM conversations GROUP BY ALL")
def query_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(T.is_query(F.col("content")), "read").otherwise("write")
    return turns(spark, sf_dir).groupBy(path.alias("path")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS distinct_tokens FROM documents")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = T.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).alias("tokens"), F.size(F.array_distinct(tokens)).alias("distinct_tokens"))


@query(r"SELECT conv_id, turn, md5(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS normalized FROM conversations")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.normalized(F.col("text"))).alias("normalized"))


@query(r"""SELECT c_custkey, regexp_extract(s, 'name is\s+([a-z]+)', 1) AS name, array_to_string(CASE WHEN len(regexp_extract_all(t, 'named\s+([A-Za-z]+)', 1)) > 0
  THEN list_transform(regexp_extract_all(t, 'named\s+([A-Za-z]+)', 1), lambda x: lower(x)) ELSE list_filter(['buddy', 'scout'], lambda x: contains(s, x)) END, ',') AS pets
FROM (SELECT c_custkey, lower(t) AS s, t FROM (SELECT c_custkey, 'My name is ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ', I have a dog named ' || c_mktsegment ELSE ' and Scout' END AS t FROM customer))""")
def names_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    tail = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(", I have a dog named "), "c_mktsegment")).otherwise(" and Scout")
    t = F.concat(F.lit("My name is "), "c_mktsegment", tail)
    return c.select("c_custkey", T.name_in(t).alias("name"), F.array_join(T.pet_names(t), ",").alias("pets"))


@query("SELECT doc_id, md5('Note on ' || source || ' {' || lang || '}: ' || text) AS prompt, source AS block FROM documents")
def prompt_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filled template, and what stands between two of its markers."""
    prompt = filled("Note on {source} {{{lang}}}: {text}", source=F.col("source"), lang=F.col("lang"), text=F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(prompt).alias("prompt"), T.block_between(prompt, "Note on ", "{").alias("block"))


HASH_SQL = """
words AS (SELECT conv_id, turn, unnest(CASE WHEN len(regexp_extract_all(lower(text), '[a-z0-9]+')) > 0 THEN regexp_extract_all(lower(text), '[a-z0-9]+') ELSE ['empty'] END) AS w FROM conversations),
counts AS (SELECT conv_id, turn, ('0x' || right(md5(w), 2))::INT % 64 AS bucket, count(*) AS n FROM words GROUP BY ALL),
weights AS (SELECT conv_id, turn, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, turn)) AS weight FROM counts)"""


@query(f"WITH {HASH_SQL} SELECT conv_id, turn, bucket, n FROM counts")
def token_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_buckets(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], F.col("text"))


@query(f"WITH {HASH_SQL} SELECT conv_id, turn, bucket, round(weight, 9) AS weight FROM weights")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hash_weights(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], F.col("text"))
    return found.select("conv_id", "turn", "bucket", F.round("weight", 9).alias("weight"))


@query("""SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'ADD' WHEN user_id % 4 = 1 THEN 'DELETE' END AS op,
  CASE WHEN user_id % 4 = 1 THEN event_type END AS target_id FROM events""")
def write_op_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in lower case, with a target, of an unknown operation, and malformed."""
    u = F.col("user_id") % 4
    raw = (
        F.when(u == 0, F.lit('{"op": "add", "target_id": ""}')).when(u == 1, F.concat(F.lit('{"op": "Delete", "target_id": "'), "event_type", F.lit('"}')))
        .when(u == 2, F.lit('{"op": "MERGE", "target_id": "x"}')).otherwise("{")
    )
    return table(spark, sf_dir, "events").select("event_id", parse_decision(raw).alias("d")).select("event_id", "d.op", "d.target_id")


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN event_type || ',x' ELSE '' END AS keywords, CASE WHEN user_id % 3 = 0 THEN event_type ELSE '' END AS description FROM events""")
def note_fields_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id") % 3
    raw = F.when(u == 0, F.concat(F.lit('{"keywords": ["'), "event_type", F.lit('", "x"], "description": "'), "event_type", F.lit('"}'))).when(u == 1, F.lit("[]")).otherwise("{bad")
    return table(spark, sf_dir, "events").select("event_id", parse_fields(raw).alias("f")).select("event_id", F.array_join("f.keywords", ",").alias("keywords"), "f.description")


KEYS_SQL = r"""
bank AS (SELECT conv_id || '-' || turn AS id, row_number() OVER (ORDER BY conv_id, turn) AS seq, text FROM conversations),
bank_keys AS (SELECT id, seq, lower(unnest(CASE WHEN len(regexp_extract_all(lower(text), '[a-z0-9]+')) > 0 THEN regexp_extract_all(lower(text), '[a-z0-9]+')[1:4] ELSE ['general'] END)) AS keyword FROM bank)"""


def _bank_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, write_seq, keyword): the first tokens of each turn; the key orders as (conv_id, turn) does."""
    first = F.array_distinct(F.slice(T.tokens(F.col("content")), 1, 4))
    keys = F.when(F.size(first) > 0, first).otherwise(F.array(F.lit("general")))
    return turns(spark, sf_dir).select("id", F.struct("bank_id", "seq").alias("write_seq"), F.explode(keys).alias("keyword"))


DECISION_SQL = f"""{KEYS_SQL}, {FIELDS_SQL},
own AS (SELECT doc_id, unnest(list_transform(keywords, lambda x: lower(x))) AS keyword FROM fields),
firsts AS (SELECT keyword, min(seq) AS seq FROM bank_keys GROUP BY keyword),
hits AS (SELECT doc_id, min(seq) AS seq FROM own JOIN firsts USING (keyword) GROUP BY doc_id),
decided AS (SELECT doc_id AS fact_id, CASE WHEN {QUESTION_SQL.format("f.text")} THEN 'NOOP' WHEN seq IS NOT NULL THEN 'UPDATE' ELSE 'ADD' END AS op,
  CASE WHEN NOT {QUESTION_SQL.format("f.text")} THEN id END AS target_id FROM fields f LEFT JOIN hits USING (doc_id) LEFT JOIN bank USING (seq))"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fact_id"), F.col("text").alias("content"))
    return write_ops.decide(facts, _bank_keywords(spark, sf_dir))


@query(f"WITH {DECISION_SQL} SELECT fact_id, op, target_id FROM decided")
def write_op_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir)


@query(f"WITH {DECISION_SQL} SELECT round(avg((op = 'UPDATE')::INT), 9) AS rate, count(*) AS ops FROM decided")
def consolidation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).agg(F.round(F.avg((F.col("op") == "UPDATE").cast("double")), 9).alias("rate"), F.count("*").alias("ops"))


@query("""SELECT user_id, event_id AS fact_id, CASE WHEN c.conv_id IS NULL THEN 'ADD' ELSE 'UPDATE' END AS op, CASE WHEN c.conv_id IS NOT NULL THEN c.conv_id || '-' || first END AS target_id
FROM events LEFT JOIN (SELECT conv_id, min(turn) AS first FROM conversations GROUP BY conv_id) c ON c.conv_id = user_id""")
def write_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For unreadable replies: the first note of the bank, here the conversation of the user's number, if there is one."""
    facts = table(spark, sf_dir, "events").select(F.col("user_id").alias("bank_id"), F.col("event_id").alias("fact_id"))
    notes = turns(spark, sf_dir).select("bank_id", "id", F.col("seq").alias("write_seq"))
    return write_ops.fallback(facts, notes).select(F.col("bank_id").alias("user_id"), "fact_id", "op", "target_id")


def text_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of all turns: (bank_id, id, content, keywords, tags, description, links, utility, write_seq)."""
    rows = turns(spark, sf_dir).withColumn("f", note_fields(F.col("content")))
    return rows.select(
        "bank_id", "id", "content", "f.keywords", "f.tags", "f.description", F.array(F.lit("l")).alias("links"), (F.col("seq") / 10.0).alias("utility"), F.col("seq").cast("long").alias("write_seq")
    )


NOTES_SQL = "notes AS (SELECT conv_id AS bank_id, conv_id || '-' || turn AS id, turn AS write_seq, text AS content, turn / 10.0 AS utility FROM conversations)"


@query(f"WITH {NOTES_SQL} SELECT bank_id, id, write_seq, md5(content) AS content FROM notes")
def list_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return banks.list_notes(text_bank(spark, sf_dir)).select("bank_id", "id", "write_seq", F.md5("content").alias("content"))


@query(f"WITH {NOTES_SQL} SELECT bank_id, id, content FROM notes WHERE id = '0-1'")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return banks.get_note(text_bank(spark, sf_dir), "0-1").select("bank_id", "id", "content")


@query(f"WITH {NOTES_SQL} SELECT bank_id, id, md5(content) AS content, CASE write_seq WHEN 2 THEN 0 ELSE 2 END AS position FROM notes WHERE write_seq IN (0, 2)")
def multi_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third, an unknown and the first note of each bank, in that order."""
    ids = [F.concat("bank_id", F.lit(f"-{k}")) for k in ("2", "none", "0")]
    wanted = turns(spark, sf_dir).select("bank_id").distinct().select("bank_id", F.array(*ids).alias("ids"))
    return banks.get_notes(text_bank(spark, sf_dir), wanted).select("bank_id", "id", F.md5("content").alias("content"), "position")


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new note and a rewritten one for each bank."""
    notes = text_bank(spark, sf_dir)
    old = notes.where("write_seq = 1").withColumn("content", F.concat(F.lit("again "), "content"))
    new = notes.where("write_seq = 0").withColumn("id", F.concat("id", F.lit("-new")))
    return banks.numbered(notes, old.unionByName(new), [F.col("id")])


@query(f"""WITH {NOTES_SQL}, tops AS (SELECT bank_id, max(write_seq) AS top FROM notes GROUP BY bank_id),
writes AS (SELECT bank_id, CASE write_seq WHEN 0 THEN id || '-new' ELSE id END AS id, CASE write_seq WHEN 1 THEN 'again ' ELSE '' END || content AS content FROM notes WHERE write_seq IN (0, 1)),
numbered AS (SELECT w.*, top + row_number() OVER (PARTITION BY bank_id ORDER BY id) AS write_seq FROM writes w JOIN tops USING (bank_id))
SELECT bank_id, id, md5(content) AS content, write_seq FROM numbered UNION ALL
SELECT bank_id, id, md5(content), write_seq FROM notes n WHERE NOT EXISTS (SELECT 1 FROM numbered w WHERE w.bank_id = n.bank_id AND w.id = n.id)""")
def bank_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = banks.upsert(text_bank(spark, sf_dir), _writes(spark, sf_dir))
    return done.select("bank_id", "id", F.md5("content").alias("content"), "write_seq")


@query(f"""WITH {NOTES_SQL} SELECT bank_id, id, round(CASE WHEN write_seq % 2 = 1 THEN 0.75 ELSE utility END, 6) AS utility, CASE WHEN write_seq % 2 = 1 THEN write_seq + 1000 ELSE write_seq END AS write_seq FROM notes""")
def bank_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = text_bank(spark, sf_dir)
    delta = notes.where("write_seq % 2 = 1").select("bank_id", "id", (F.col("write_seq") + 1000).alias("write_seq"), F.lit(0.75).alias("utility"))
    unknown = notes.select("bank_id", F.lit("unknown").alias("id"), F.lit(9999).cast("long").alias("write_seq"), F.lit(0.1).alias("utility"))
    return banks.patch(notes, delta.unionByName(unknown)).select("bank_id", "id", F.round("utility", 6).alias("utility"), "write_seq")


@query(f"WITH {NOTES_SQL} SELECT bank_id, id FROM notes WHERE write_seq <> 2")
def bank_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = text_bank(spark, sf_dir)
    return banks.delete(notes, notes.where("write_seq = 2")).select("bank_id", "id")


@query(f"""WITH {NOTES_SQL}, new AS (SELECT bank_id, id || '-new' AS id, content, CASE write_seq WHEN 0 THEN bank_id || '-1' ELSE 'none' END AS target_id FROM notes WHERE write_seq IN (0, 2))
SELECT new.bank_id, coalesce(t.id, new.id) AS id, md5(new.content) AS content, round(coalesce(t.utility, 0.5), 6) AS utility FROM new LEFT JOIN notes t ON t.bank_id = new.bank_id AND t.id = new.target_id""")
def merge_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = text_bank(spark, sf_dir)
    target = F.when(F.col("write_seq") == 0, F.concat("bank_id", F.lit("-1"))).otherwise("none")
    new = notes.where("write_seq IN (0, 2)").withColumn("target_id", target).withColumn("id", F.concat("id", F.lit("-new"))).withColumn("utility", F.lit(0.5))
    return banks.merge_update(notes, new).select("bank_id", "id", F.md5("content").alias("content"), F.round("utility", 6).alias("utility"))


@query(f"WITH {NOTES_SQL} SELECT id, md5(content) AS content, round(utility, 6) AS utility, 1 AS n_links FROM notes")
def note_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = text_bank(spark, sf_dir).withColumn("ts", F.lit("2024-01-01").cast("timestamp")).withColumn("embedding", F.array(F.lit(0.5))).withColumn("intent", F.array(F.lit(0.25)))
    back = notes_from_json(note_json(notes))
    return back.select("id", F.md5("content").alias("content"), F.round("utility", 6).alias("utility"), F.size("links").alias("n_links"))


@query(f"WITH {FIELDS_SQL} SELECT doc_id, left(description, 80) AS description, least(len(keywords), 4) AS n_keywords, least(len(tags), 3) AS n_tags FROM fields")
def bank_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").select("doc_id", note_fields(F.col("text")).alias("f"))
    return made.select("doc_id", F.substring("f.description", 1, 80).alias("description"), F.size(F.slice("f.keywords", 1, 4)).alias("n_keywords"), F.size(F.slice("f.tags", 1, 3)).alias("n_tags"))


@query(r"""SELECT doc_id, md5(text || ' ' || lang || ' ' || source || ' ' || array_to_string([lang, source], ' ')) AS enriched FROM documents""")
def embedding_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.embedding_text(F.col("text"), F.array("lang"), F.array("source"), F.array_join(F.array("lang", "source"), " "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text).alias("enriched"))


@query("SELECT conv_id, arg_max(text, turn) AS last, count(*) AS turns FROM conversations GROUP BY conv_id")
def last_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("last"), F.count("*").alias("turns"))


@query(f"""WITH {NOTES_SQL}, oldest AS (SELECT bank_id, arg_min(id, write_seq) AS oldest FROM notes GROUP BY bank_id),
writes AS (SELECT n.bank_id, id || '-f' AS own, 'again ' || content AS content, write_seq + 1000 AS write_seq, write_seq % 6 = 2 AS gone,
  CASE write_seq % 6 WHEN 1 THEN oldest WHEN 2 THEN id WHEN 3 THEN oldest ELSE id || '-f' END AS id FROM notes n JOIN oldest o ON o.bank_id = n.bank_id WHERE write_seq % 6 <> 4),
last AS (SELECT * FROM writes QUALIFY row_number() OVER (PARTITION BY bank_id, id ORDER BY write_seq DESC) = 1)
SELECT l.bank_id, l.id, md5(l.content) AS content, round(coalesce(n.utility, 0.5), 6) AS utility, l.write_seq, CASE WHEN n.id IS NULL THEN 0 ELSE 1 END AS n_links
FROM last l LEFT JOIN notes n ON n.bank_id = l.bank_id AND n.id = l.id WHERE NOT gone
UNION ALL SELECT bank_id, id, md5(content), round(utility, 6), write_seq, 1 FROM notes ANTI JOIN last USING (bank_id, id)""")
def write_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that add, update the oldest note, delete, cannot be read, do nothing, and update an unknown note."""
    notes = text_bank(spark, sf_dir)
    oldest = F.min_by("id", "write_seq").over(W.partitionBy("bank_id"))
    said = [F.lit('{"op": "add"}'), F.concat(F.lit('{"op": "Update", "target_id": "'), "oldest", F.lit('"}')), F.concat(F.lit('{"op": "DELETE", "target_id": "'), "id", F.lit('"}')),
            F.lit("{no object"), F.lit('{"op": "noop"}'), F.lit('{"op": "UPDATE", "target_id": "unknown"}')]
    replied = notes.withColumn("oldest", oldest).withColumn("reply", F.element_at(F.array(*said), (F.col("write_seq") % 6 + 1).cast("int")))
    facts = replied.drop("oldest").withColumns({
        "id": F.concat("id", F.lit("-f")), "content": F.concat(F.lit("again "), "content"), "links": F.array().cast("array<string>"),
        "utility": F.lit(0.5), "write_seq": F.col("write_seq") + 1000,
    })
    after = write_ops.write_path(notes, facts)
    return after.select("bank_id", "id", F.md5("content").alias("content"), F.round("utility", 6).alias("utility"), "write_seq", F.size("links").alias("n_links"))


@query(r"""SELECT c.conv_id::VARCHAR AS bank_id, 's' || c.turn AS id, md5('Query: ' || regexp_replace(c.text, '^\s+|\s+$', '', 'g') || ' | Answer: ' || regexp_replace(a.text, '^\s+|\s+$', '', 'g') || ' | Reward: 0.5') AS content,
  0.5::DOUBLE AS utility, 0 AS n_links, 1.0::DOUBLE AS norm FROM conversations c JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 WHERE c.role = 'user' AND a.role = 'assistant'""")
def consolidated_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn and the assistant's reply after it, rewarded by a half; the other turns are no answered ones."""
    c = table(spark, sf_dir, "conversations")
    order = W.partitionBy("conv_id").orderBy("turn")
    reply = F.when((F.lead("role").over(order) == "assistant") & (F.lead("turn").over(order) == F.col("turn") + 1), F.lead("text").over(order))
    answered = c.select(
        F.col("conv_id").cast("string").alias("bank_id"), F.concat(F.lit("s"), "turn").alias("id"), F.when(F.col("role") == "user", F.col("text")).alias("query"),
        reply.alias("answer"), F.lit(0.5).alias("reward"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.col("turn").cast("long").alias("write_seq"),
    )
    made = write_ops.consolidate(answered)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    return made.select("bank_id", "id", F.md5("content").alias("content"), "utility", F.size("links").alias("n_links"), F.round(norm, 6).alias("norm"))
