"""Utilities from rewards, and evaluation of answering systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.functions.vector import hash_weights
from engram.operators import evaluation as ev
from engram.operators import utility
from engram.operators.replay import replay
from engram.operators.token_match import token_match
from engram.plans.registry import query, table
from engram.profiling import StageWatch, stage_means
from engram.schema import Params

#: The reward of each kind of event.
REWARDS = {"purchase": 1.0, "signup": 0.8, "click": 0.5, "view": 0.1}
REWARD_SQL = "CASE event_type WHEN 'purchase' THEN 1.0::DOUBLE WHEN 'signup' THEN 0.8 WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.1 ELSE -1.0 END"


def reward() -> Column:
    out = None
    for kind, value in REWARDS.items():
        out = F.when(F.col("event_type") == kind, value) if out is None else out.when(F.col("event_type") == kind, value)
    return out.otherwise(-1.0)


def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), reward().alias("reward"))


STEPS_SQL = f"""steps AS (SELECT user_id, event_id, {REWARD_SQL} AS r, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(f"WITH {STEPS_SQL} SELECT user_id AS key, count(*) AS steps, round(pow(0.9, count(*)) * 0.5 + sum(r * 0.1 * pow(0.9, n - i)) + 1e-10, 6) AS utility FROM steps GROUP BY user_id")
def ema_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Early values are short decimals that end in 5: the small addend keeps rounding off the tie.
    return utility.ema(rewards(spark, sf_dir)).select("key", "steps", F.round(F.col("utility") + 1e-10, 6).alias("utility"))


@query(f"""WITH RECURSIVE {STEPS_SQL}, walk AS (SELECT user_id, i, event_id, 0.5 + 0.1 * (r - 0.5) AS q FROM steps WHERE i = 1 UNION ALL
  SELECT s.user_id, s.i, s.event_id, q + 0.1 * (r - q) FROM walk JOIN steps s ON s.user_id = walk.user_id AND s.i = walk.i + 1)
SELECT user_id AS key, i AS step, event_id AS seq, round(q + 1e-10, 6) AS utility FROM walk""")
def ema_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utility.ema_trajectory(rewards(spark, sf_dir)).select("key", "step", "seq", F.round(F.col("utility") + 1e-10, 6).alias("utility"))


@query(f"""WITH {STEPS_SQL}, alphas AS (SELECT unnest([0.05::DOUBLE, 0.1, 0.3]) AS alpha)
SELECT alpha, user_id AS key, round(pow(1 - alpha, count(*)) * 0.5 + sum(r * alpha * pow(1 - alpha, n - i)), 6) AS utility FROM steps, alphas GROUP BY alpha, user_id""")
def ema_alpha_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, out = rewards(spark, sf_dir), None
    for alpha in (0.05, 0.1, 0.3):
        one = utility.ema(rows, alpha).select(F.lit(alpha).alias("alpha"), "key", F.round("utility", 6).alias("utility"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {STEPS_SQL}, after AS (SELECT user_id, pow(0.9, count(*)) * 0.5 + sum(r * 0.1 * pow(0.9, n - i)) AS q FROM steps GROUP BY user_id)
SELECT c_custkey AS id, 0.5::DOUBLE AS q_before, round(q, 6) AS q_after FROM customer JOIN after ON user_id = c_custkey""")
def utility_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = utility.ema(rewards(spark, sf_dir)).select(F.col("key").alias("id"), F.round("utility", 6).alias("utility"))
    before = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(0.5).alias("utility"))
    return utility.utility_change(before, after, before)


@query(f"""SELECT event_id, round(CASE WHEN stddev_pop(r) OVER w < 1e-12 THEN 0 ELSE (r - avg(r) OVER w) / stddev_pop(r) OVER w END, 6) AS advantage
FROM (SELECT event_id, user_id, {REWARD_SQL} AS r FROM events) WINDOW w AS (PARTITION BY user_id)""")
def group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", reward().alias("r"))
    return utility.group_advantage(rows, "user_id", "r").select("event_id", F.round("advantage", 6).alias("advantage"))


# Items of an evaluation: each conversation's last user turn asks, its last assistant turn answers, what was before is history.
ITEMS_SQL = """
ends AS (SELECT conv_id, max(CASE WHEN role = 'user' THEN turn END) AS ask, arg_max(CASE WHEN role = 'assistant' THEN text END, CASE WHEN role = 'assistant' THEN turn END) AS answer FROM conversations GROUP BY conv_id),
items AS (SELECT e.conv_id, coalesce(q.text, '') AS query, coalesce(answer, '') AS answer, ask, (SELECT string_agg(text, chr(10) ORDER BY turn) FROM conversations h WHERE h.conv_id = e.conv_id AND h.turn < ask) AS history,
  (SELECT arg_max(text, turn) FROM conversations h WHERE h.conv_id = e.conv_id AND h.turn < ask) AS last FROM ends e LEFT JOIN conversations q ON q.conv_id = e.conv_id AND q.turn = ask),
predictions AS (SELECT conv_id, 'no_memory' AS system, query AS prediction FROM items UNION ALL SELECT conv_id, 'full_context', coalesce(history, '') FROM items UNION ALL SELECT conv_id, 'last_history', coalesce(last, '') FROM items)"""
NORM_SQL = r"regexp_replace(regexp_replace(lower({0}), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, query, answer, ask, history)"""
    c = table(spark, sf_dir, "conversations")
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    past = F.array_sort(F.collect_list(F.struct("turn", "text")))
    ends = c.groupBy(F.col("conv_id").alias("id")).agg(
        F.max(F.when(user, F.col("turn"))).alias("ask"), F.max_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("query"),
        F.max_by(F.when(assistant, F.col("text")), F.when(assistant, F.col("turn"))).alias("answer"), past.alias("past"),
    )
    history = F.transform(F.filter("past", lambda t: t["turn"] < F.col("ask")), lambda t: t["text"])
    return ends.select("id", F.coalesce("query", F.lit("")).alias("query"), F.coalesce("answer", F.lit("")).alias("answer"), "ask", F.coalesce(history, F.array().cast("array<string>")).alias("history"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, prediction): what three simple systems are given to answer with."""
    i = items(spark, sf_dir)
    systems = F.array(*[F.struct(F.lit(k).alias("label"), v.alias("prediction")) for k, v in (
        ("no_memory", F.col("query")), ("full_context", F.array_join("history", "\n")), ("last_history", F.coalesce(F.try_element_at("history", F.lit(-1)), F.lit("")))
    )])
    return i.select("id", F.explode(systems).alias("s")).select("id", "s.label", "s.prediction")


@query(f"WITH {ITEMS_SQL} SELECT conv_id AS id, md5(query) AS query, md5(answer) AS answer, md5(coalesce(history, '')) AS history FROM items")
def eval_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", F.md5("query").alias("query"), F.md5("answer").alias("answer"), F.md5(F.array_join("history", "\n")).alias("history"))


@query(f"WITH {ITEMS_SQL} SELECT system, conv_id AS id, md5(prediction) AS prediction FROM predictions")
def baseline_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select(F.col("label").alias("system"), "id", F.md5("prediction").alias("prediction"))


@query(f"""SELECT coalesce(avg(({NORM_SQL.format("a.text")} = {NORM_SQL.format("'  ' || replace(b.text, ' ', ' ' || chr(9))")})::INT::DOUBLE), 0.0) AS em
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn""")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", "turn", F.col("text").alias("prediction")).join(c.select("conv_id", "turn", F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit(" \t"))).alias("reference")), ["conv_id", "turn"])
    return ev.compute_metrics(rows, ["em"])


@query(f"""WITH {ITEMS_SQL} SELECT 'conversations' AS dataset, system, round(avg(({NORM_SQL.format("prediction")} = {NORM_SQL.format("answer")})::INT::DOUBLE), 9) AS em, count(*) AS n
FROM predictions JOIN items USING (conv_id) GROUP BY system""")
def eval_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).join(items(spark, sf_dir).select("id", "answer"), "id")
    scored = rows.withColumn("em", ev.exact(F.col("prediction"), F.col("answer")))
    return scored.groupBy(F.lit("conversations").alias("dataset"), F.col("label").alias("system")).agg(F.round(F.avg("em"), 9).alias("em"), F.count("*").alias("n"))


@query()
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest common subsequences have no plain SQL; tests hold them against a table-filling version."""
    rows = predictions(spark, sf_dir).join(items(spark, sf_dir).select("id", F.col("answer").alias("reference")), "id")
    return ev.compute_metrics(rows, ["em", "rougeL", "bertscore_f1"], ("label",))


MATCH_SQL = f"""{ITEMS_SQL},
scored AS (SELECT row_number() OVER () AS pair, conv_id, system, prediction, answer FROM predictions JOIN items USING (conv_id)),
said AS (SELECT pair, side, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS token FROM (SELECT pair, 0 AS side, prediction AS t FROM scored UNION ALL SELECT pair, 1, answer FROM scored)),
refs AS (SELECT DISTINCT answer FROM scored),
df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(answer), '[a-z0-9]+'))) AS token FROM refs) GROUP BY token),
weighed AS (SELECT pair, side, token, count(*) * (1 + ln(((SELECT count(*) FROM refs) + 1.0) / (coalesce(any_value(df), 0) + 1))) AS weight FROM said LEFT JOIN df USING (token) GROUP BY pair, side, token),
grams AS (SELECT token, ('0x' || right(md5(substr('<' || token || '>', i::INT, 3)), 2))::INT AS place, count(*) AS n
  FROM (SELECT token, unnest(range(1, len(token) + 1)) AS i FROM (SELECT DISTINCT token FROM weighed)) GROUP BY ALL),
units AS (SELECT token, place, n / sqrt(sum(n * n) OVER (PARTITION BY token)) AS x FROM grams),
alike AS MATERIALIZED (SELECT a.token AS p, b.token AS r, sum(a.x * b.x) AS sim FROM units a JOIN units b ON b.place = a.place GROUP BY ALL),
met AS (SELECT a.pair, a.token AS p, b.token AS r, coalesce(sim, 0) AS sim FROM weighed a JOIN weighed b ON b.pair = a.pair AND a.side = 0 AND b.side = 1 LEFT JOIN alike ON alike.p = a.token AND alike.r = b.token),
precise AS (SELECT m.pair, sum(best * weight) / sum(weight) AS x FROM (SELECT pair, p, max(sim) AS best FROM met GROUP BY ALL) m JOIN weighed w ON w.pair = m.pair AND w.side = 0 AND w.token = m.p GROUP BY m.pair),
recalled AS (SELECT m.pair, sum(best * weight) / sum(weight) AS x FROM (SELECT pair, r, max(sim) AS best FROM met GROUP BY ALL) m JOIN weighed w ON w.pair = m.pair AND w.side = 1 AND w.token = m.r GROUP BY m.pair)"""


@query(f"""WITH {MATCH_SQL} SELECT conv_id AS id, system AS label, round(coalesce(a.x, 0), 6) AS precision, round(coalesce(b.x, 0), 6) AS recall,
  round(CASE WHEN coalesce(a.x + b.x, 0) > 0 THEN 2 * a.x * b.x / (a.x + b.x) ELSE 0 END, 6) AS f
FROM scored LEFT JOIN precise a ON a.pair = scored.pair LEFT JOIN recalled b ON b.pair = scored.pair""")
def token_match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy matching of the tokens of each prediction and its reference, in both directions."""
    rows = predictions(spark, sf_dir).join(items(spark, sf_dir).select("id", F.col("answer").alias("reference")), "id")
    keyed = rows.withColumn("pair", F.concat_ws(":", "id", "label"))
    return token_match(keyed).join(keyed.select("pair", "id", "label"), "pair").select("id", "label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f")])


RUNS_SQL = f"""runs AS (SELECT event_type || '/' || user_id AS run, ['em', 'rougeL', 'bertscore_f1', 'other'][(event_id % 4 + 1)::INT] AS metric, avg({REWARD_SQL}) AS value FROM events GROUP BY ALL)"""


@query(f"""WITH {RUNS_SQL} SELECT run, round(coalesce(max(value) FILTER (metric = 'em'), 0), 9) AS em, round(coalesce(max(value) FILTER (metric = 'rougeL'), 0), 9) AS "rougeL",
  round(coalesce(max(value) FILTER (metric = 'bertscore_f1'), 0), 9) AS bertscore_f1 FROM runs GROUP BY run""")
def results_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("em", "rougeL", "bertscore_f1", "other")])
    metric = F.element_at(names, (F.col("event_id") % 4 + 1).cast("int"))
    runs = table(spark, sf_dir, "events").groupBy(F.concat_ws("/", "event_type", "user_id").alias("run"), metric.alias("metric")).agg(F.avg(reward()).alias("value"))
    return ev.results_table(runs).select("run", *[F.round(m, 9).alias(m) for m in ev.METRICS])


@query(f"""WITH {ITEMS_SQL} SELECT i.conv_id AS id, system AS label, md5(CASE WHEN i.conv_id % 5 = 0 THEN '' ELSE prediction END) AS answer FROM items i JOIN predictions USING (conv_id)""")
def annotation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with every system's answer, some of them missing; the order within an item is by hash and not compared."""
    some = predictions(spark, sf_dir).where("id % 5 <> 0")
    made = ev.annotation_set(items(spark, sf_dir), some)
    return made.select("id", F.explode("systems").alias("s")).select("id", "s.label", F.md5("s.answer").alias("answer"))


@query(f"""WITH {ITEMS_SQL} SELECT conv_id AS id, system AS label, row_number() OVER (PARTITION BY conv_id ORDER BY md5('42:' || conv_id || ':' || system)) AS place FROM predictions""")
def annotation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which an item's systems stand, which the seed alone decides."""
    made = ev.annotation_set(items(spark, sf_dir), predictions(spark, sf_dir))
    return made.select("id", F.posexplode("systems").alias("at", "s")).select("id", "s.label", (F.col("at") + 1).cast("long").alias("place"))


@query("SELECT user_id::VARCHAR AS id, arg_max(event_type, event_id) AS prediction FROM events GROUP BY user_id")
def predictions_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("prediction"), F.col("event_id").alias("line"))
    return ev.last_predictions(rows)


@query("SELECT event_type AS stage, round(avg(value), 6) AS mean_ms FROM events GROUP BY event_type")
def stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("duration_ms"))
    return stage_means(times).select("stage", F.round("mean_ms", 6).alias("mean_ms"))


@query(f"""WITH {STEPS_SQL}, utilities AS (SELECT user_id, pow(0.9, count(*)) * 0.5 + sum(r * 0.1 * pow(0.9, n - i)) AS q FROM steps GROUP BY user_id)
SELECT 'reward' AS stage, count(*) AS rows FROM events UNION ALL SELECT 'update', count(*) FROM utilities
UNION ALL SELECT 'keep', count(*) FROM utilities WHERE round(q, 6) >= 0.3""")
def stage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What passes each stage from rewards to the useful keys, counted in the run that works the keys out."""
    watch = StageWatch()
    rows = watch.at("reward", rewards(spark, sf_dir))
    utilities = watch.at("update", utility.ema(rows))
    watch.at("keep", utilities.where(F.round("utility", 6) >= 0.3)).write.format("noop").mode("overwrite").save()
    return watch.frame(spark).select("stage", "rows")


@query(f"""SELECT event_type AS run, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std FROM (SELECT event_type, user_id % 5 AS seed, avg(value) AS m FROM events GROUP BY ALL) GROUP BY event_type""")
def seeds_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_seed = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 5).alias("seed")).agg(F.avg("value").alias("m"))
    return per_seed.groupBy(F.col("event_type").alias("run")).agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("std"))


@query(f"""WITH {ITEMS_SQL},
words AS (SELECT conv_id, turn, unnest(CASE WHEN len(regexp_extract_all(lower(text), '[a-z0-9]+')) > 0 THEN regexp_extract_all(lower(text), '[a-z0-9]+') ELSE ['empty'] END) AS w FROM conversations),
counts AS (SELECT conv_id, turn, ('0x' || right(md5(w), 2))::INT % 64 AS bucket, count(*) AS n FROM words GROUP BY ALL),
weights AS (SELECT conv_id, turn, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, turn)) AS weight FROM counts),
sims AS (SELECT i.conv_id, b.turn, sum(a.weight * b.weight) AS sim FROM items i JOIN weights a ON a.conv_id = i.conv_id AND a.turn = i.ask JOIN weights b ON b.conv_id = i.conv_id AND b.bucket = a.bucket AND b.turn < i.ask GROUP BY ALL),
past AS (SELECT i.conv_id, c.turn, coalesce(sim, 0) AS sim FROM items i JOIN conversations c ON c.conv_id = i.conv_id AND c.turn < i.ask LEFT JOIN sims s ON s.conv_id = i.conv_id AND s.turn = c.turn)
SELECT conv_id AS id, turn, rank, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(sim, 9) DESC, turn) AS rank FROM past) WHERE rank <= 5""")
def sim_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each conversation's question the most similar earlier turns by hashed tokens: a join of sparse vectors within a bank."""
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "id")
    w = hash_weights(c, ["id", "turn"], F.col("text"))
    ask = items(spark, sf_dir).select("id", "ask")
    q = w.join(ask, (w["id"] == ask["id"]) & (w["turn"] == ask["ask"])).select(w["id"], "ask", "bucket", F.col("weight").alias("q"))
    sims = q.join(w, ["id", "bucket"]).where("turn < ask").groupBy("id", "turn").agg(F.sum(F.col("q") * F.col("weight")).alias("sim"))
    past = c.join(ask, "id").where("turn < ask").select("id", "turn").join(sims, ["id", "turn"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc(F.round("sim", 9)), "turn"))
    return past.withColumn("rank", rank).where(F.col("rank") <= Params().k2).select("id", "turn", "rank", F.round("sim", 6).alias("sim"))


@query()
def replay_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation replayed in order: user turns are written and asked, the reward is 1. Tests hold it against worked cases."""
    c = table(spark, sf_dir, "conversations")
    ask = F.when(F.col("role") == "user", F.col("text"))
    turns = c.select(F.col("conv_id").cast("string").alias("bank_id"), "turn", F.col("text").alias("content"), ask.alias("query"), F.lit(1.0).alias("reward"))
    return replay(turns)
