"""Writes in order: each fact is decided against the bank as all facts before it have left it, without a fold over the bank.

A non-query fact supersedes the live note that was written first among those that share a keyword with it, and is a note of its own if there is
none. So a decision depends on earlier ones only through when a version dies: that is when the first fact chose it. Rounds
of speculation find the decisions: given a guess of all of them, versions have spans of life, and every fact of the banks that
are still open is decided again against these. A bank whose round changed nothing is done: its first fact was right from the first
round on, each next one a round after those before it at the latest, so what no round changes is what a fold decides. Chains that
hang on one keyword are right at once, as the first guess takes a keyword's versions in turn. Decisions that wait on one another through
many keywords settle slowly, so after ROUNDS rounds the facts of a bank from its first unsettled one on are folded, as keywords and places
alone: about a hundred bytes a fact, in a task a bank.

In a round, the live versions of a keyword are found by two windows over it: of versions in the order of writing only those matter that
outlive all earlier ones, and these follow one another, each for the time from the death of the one before to its own; a fact
takes the one of its time. Rows hold keywords and places in the order, no texts.

Null and odd input: a null bank is a bank; a fact without keywords is its own note; facts whose seq is alike go by id; a note and
a fact may share an id, which then names both.
"""

from __future__ import annotations

import functools
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.functions.rules import note_fields
from engram.functions.text import is_query
from engram.shared import delete, written

ROUNDS = 4
#: A place in the order of writing: notes of the table (0) before facts (1).
_PLACE = "struct<kind: int, seq: bigint, id: string>"


def _place(kind: int, seq: Column, name: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), seq.cast("long").alias("seq"), name.cast("string").alias("id")).cast(_PLACE)


def _merged(rows: DataFrame) -> DataFrame:
    """The other side of a join of versions by bank and place or keyword: it has about as many rows as there are facts, so it is never
    sent through the driver, however small its packed files are. Tables of a row a bank are left to Spark."""
    return rows.hint("merge")


def _end() -> Column:
    """After all versions."""
    return _place(2, F.lit(0), F.lit(""))


def _keywords(notes: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bank, at, keyword) of all versions that write, and (bank, at) of the facts among them."""
    said = facts.where(~F.coalesce("is_query", F.lit(False))).select(F.col("bank_id").alias("bank"), _place(1, F.col("seq"), F.col("id")).alias("at"), "keywords")
    old = notes.select(F.col("bank_id").alias("bank"), _place(0, F.col("write_seq"), F.col("id")).alias("at"), "keywords")
    words = said.unionByName(old).select("bank", "at", F.explode(F.array_distinct(F.transform("keywords", F.lower))).alias("keyword"))
    return words.where("keyword IS NOT NULL"), said.select("bank", "at")


def _first_guess(words: DataFrame) -> DataFrame:
    """(bank, at, target): of each keyword the versions in turn, as many at a time as the table has (one at least)."""
    by = W.partitionBy("bank", "keyword")
    turn = by.orderBy("at")
    ranked = words.withColumn("k", F.row_number().over(turn)).withColumn("m", F.greatest(F.sum((F.col("at.kind") == 0).cast("int")).over(by), F.lit(1)))
    back = ranked.select("bank", "keyword", (F.col("k") + F.col("m")).alias("k"), F.col("at").alias("before"))
    later = ranked.where("at.kind = 1").select(F.col("bank").alias("b"), "at", F.col("keyword").alias("w"), F.col("k").alias("i"))
    met = later.join(_merged(back), F.col("b").eqNullSafe(F.col("bank")) & (F.col("w") == F.col("keyword")) & (F.col("i") == F.col("k")), "left")
    return met.groupBy(F.col("b").alias("bank"), "at").agg(F.min("before").alias("target"))


def _decided(words: DataFrame, guess: DataFrame) -> DataFrame:
    """(bank, at, target) of every fact with a keyword, given a guess of all decisions."""
    deaths = guess.where("target IS NOT NULL").groupBy(F.col("bank").alias("d_bank"), F.col("target").alias("d_at")).agg(F.min("at").alias("death"))
    lives = words.join(_merged(deaths), F.col("bank").eqNullSafe(F.col("d_bank")) & (F.col("at") == F.col("d_at")), "left").select("bank", "keyword", "at", F.coalesce("death", _end()).alias("death"))
    before = W.partitionBy("bank", "keyword").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    outlives = lives.withColumn("past", F.max("death").over(before)).where(F.col("past").isNull() | (F.col("death") > F.col("past")))
    spans = outlives.select("bank", "keyword", F.col("death").alias("time"), F.lit(0).alias("asks"), F.col("at").alias("version"))
    asked = words.where("at.kind = 1").select("bank", "keyword", F.col("at").alias("time"), F.lit(1).alias("asks"), F.lit(None).cast(_PLACE).alias("version"))
    since = W.partitionBy("bank", "keyword").orderBy(F.desc("time"), "asks").rowsBetween(W.unboundedPreceding, 0)
    live = spans.unionByName(asked).withColumn("found", F.last("version", True).over(since)).where("asks = 1")
    return live.groupBy("bank", F.col("time").alias("at")).agg(F.min(F.when(F.col("found") < F.col("time"), F.col("found"))).alias("target"))


def _same_bank(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _fold(frame: pd.DataFrame) -> pd.DataFrame:
    """The decisions of a bank's last facts in order; rows (bank, kind, seq, id, keywords) of facts (kind 1) and of the versions that live before
    them, places alone and no texts. A keyword has a queue of its versions, oldest first; dead ones go when they come to its head."""
    frame = frame.sort_values(["place", "kind", "seq", "id"], kind="stable")
    queues: dict[str, deque[int]] = {}
    dead, chosen = np.zeros(len(frame), dtype=bool), np.full(len(frame), -1)
    for i, (asks, words) in enumerate(zip(frame["place"].tolist(), frame["keywords"].tolist(), strict=True)):
        if asks:
            for w in words:
                queue = queues.get(w)
                while queue and dead[queue[0]]:
                    queue.popleft()
                if queue and (chosen[i] < 0 or queue[0] < chosen[i]):
                    chosen[i] = queue[0]
            if chosen[i] >= 0:
                dead[chosen[i]] = True
        for w in words:
            queues.setdefault(w, deque()).append(i)
    asks = (frame["place"] == 1).to_numpy()
    to, mine = frame.iloc[np.maximum(chosen[asks], 0)], frame[asks]
    out = {"bank": mine["bank"].tolist(), "seq": mine["seq"].tolist(), "id": mine["id"].tolist()}
    none = (chosen[asks] < 0).tolist()
    for c in ("kind", "seq", "id"):
        out[f"t_{c}"] = [None if n else v for n, v in zip(none, to[c].tolist(), strict=True)]
    return pd.DataFrame(out).astype({"t_kind": "Int32", "t_seq": "Int64"})


def _rest(words: DataFrame, after: DataFrame, cuts: DataFrame) -> DataFrame:
    """(bank, at, target) of the facts of banks that are still open, from each bank's first unsettled one on; cuts (k_bank, cut)."""
    deaths = after.where("target IS NOT NULL").join(cuts, _same_bank("bank", "k_bank")).where("at < cut").select(F.col("bank").alias("d_bank"), F.col("target").alias("d_at"))
    mine = words.join(cuts, _same_bank("bank", "k_bank")).drop("k_bank").join(_merged(deaths), _same_bank("bank", "d_bank") & (F.col("at") == F.col("d_at")), "left_anti")
    place = F.when((F.col("at.kind") == 1) & (F.col("at") >= F.col("cut")), 1).otherwise(0)
    versions = mine.groupBy("bank", "at", place.alias("place")).agg(F.collect_set("keyword").alias("keywords"))
    kind = dict(words.dtypes)["bank"]
    folded = versions.select("bank", "place", "at.*", "keywords").groupBy("bank").applyInPandas(_fold, f"bank {kind}, seq long, id string, t_kind int, t_seq long, t_id string")
    target = F.when(F.col("t_kind").isNotNull(), F.struct(F.col("t_kind").alias("kind"), F.col("t_seq").alias("seq"), F.col("t_id").alias("id")))
    return folded.select("bank", _place(1, F.col("seq"), F.col("id")).alias("at"), target.cast(_PLACE).alias("target"))


def targets(notes: DataFrame, facts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(bank, at, target): the version that each fact supersedes, null if none; notes (bank_id, id, write_seq, keywords), facts (bank_id, id,
    seq, keywords, is_query), distinct in (bank_id, seq, id). The driver sees whether banks are open after each round."""
    words, every = (written(x, "writes") for x in _keywords(notes, facts))
    guess, mine, parts, made = _first_guess(words), words, [], [words]
    for left in range(rounds, 0, -1):
        guess = written(guess, "guess")
        old = guess.select(F.col("bank").alias("o_bank"), F.col("at").alias("o_at"), F.col("target").alias("old"))
        after = written(_decided(mine, guess).join(_merged(old), _same_bank("bank", "o_bank") & (F.col("at") == F.col("o_at"))).select("bank", "at", "target", "old"), "decided")
        # Before the first change of a bank all is settled, and so is that change itself.
        cuts = written(after.where(~F.col("target").eqNullSafe(F.col("old"))).groupBy(F.col("bank").alias("k_bank")).agg(F.min("at").alias("cut")), "open")
        made += [guess, after, cuts]
        parts.append(after.join(cuts, _same_bank("bank", "k_bank"), "left_anti").select("bank", "at", "target"))
        if cuts.isEmpty():
            break
        if left == 1:
            settled = after.join(cuts, _same_bank("bank", "k_bank")).where("at < cut").select("bank", "at", "target")
            parts += [settled, _rest(words, after, cuts)]
        else:
            guess = after.join(cuts, _same_bank("bank", "k_bank"), "left_semi").select("bank", "at", "target")
            mine = words.join(cuts, _same_bank("bank", "k_bank"), "left_semi")
    whole = functools.reduce(DataFrame.unionByName, parts).select(F.col("bank").alias("w_bank"), F.col("at").alias("w_at"), "target")
    out = written(every.join(_merged(whole), _same_bank("bank", "w_bank") & (F.col("at") == F.col("w_at")), "left").select("bank", "at", "target"), "targets")
    delete(every, *made)
    return out


def chains(decided: DataFrame) -> DataFrame:
    """(bank, at, root): the version with which each fact's note began, found by doubling steps."""
    fact = F.when(F.col("target.kind") == 1, F.col("target"))
    steps = written(decided.select("bank", "at", fact.alias("up"), F.when(fact.isNull(), F.coalesce("target", "at")).alias("root")), "chains")
    while steps.where("root IS NULL").limit(1).count():
        above = steps.select(F.col("bank").alias("a_bank"), F.col("at").alias("a_at"), F.col("up").alias("a_up"), F.col("root").alias("a_root"))
        met = steps.join(_merged(above), F.col("bank").eqNullSafe(F.col("a_bank")) & (F.col("up") == F.col("a_at")), "left")
        after = written(met.select("bank", "at", F.when(F.col("root").isNull(), F.col("a_up")).alias("up"), F.coalesce("root", "a_root").alias("root")), "chains")
        delete(steps)
        steps = after
    return steps.select("bank", "at", "root")


def decide_in_order(notes: DataFrame, facts: DataFrame) -> DataFrame:
    """(bank_id, id, seq, op, note_id, root_kind, root_seq) for each fact: NOOP of a query, UPDATE or ADD, and the note that it wrote;
    root_kind is 0 where that note is one of the table."""
    decided = targets(notes, facts)
    roots = chains(decided).select(F.col("bank").alias("r_bank"), F.col("at").alias("r_at"), "root")
    ops = decided.join(_merged(roots), F.col("bank").eqNullSafe(F.col("r_bank")) & (F.col("at") == F.col("r_at"))).select(
        "bank", "at", F.when(F.col("target").isNull(), "ADD").otherwise("UPDATE").alias("op"), "root"
    )
    own = facts.select("bank_id", "id", "seq", _place(1, F.col("seq"), F.col("id")).alias("_at"), F.coalesce("is_query", F.lit(False)).alias("_query"))
    joined = own.join(_merged(ops), F.col("bank_id").eqNullSafe(F.col("bank")) & (F.col("_at") == F.col("at")) & ~F.col("_query"), "left")
    return joined.select("bank_id", "id", "seq", F.when(F.col("_query"), "NOOP").otherwise(F.col("op")).alias("op"), F.col("root.id").alias("note_id"), F.col("root.kind").alias("root_kind"), F.col("root.seq").alias("root_seq"))


def facts_of(contents: DataFrame) -> DataFrame:
    """contents (bank_id, id, seq, content) with what decisions need: keywords and is_query."""
    return contents.withColumn("keywords", note_fields(F.col("content"))["keywords"]).withColumn("is_query", is_query(F.col("content")))


def write_in_order(notes: DataFrame, facts: DataFrame) -> DataFrame:
    """The table after all facts: notes and facts have a note's columns, facts also seq and is_query. Of each note the last write stays, with the
    links and the utility with which the note began; write_seq goes on from the table's by the facts' seq."""
    decided = written(decide_in_order(notes, facts).where("op <> 'NOOP'"), "decisions")
    last = decided.groupBy("bank_id", "note_id", "root_kind", "root_seq").agg(F.max(F.struct("seq", "id")).alias("last"))
    last = last.select(F.col("bank_id").alias("l_bank"), "note_id", "root_kind", "root_seq", F.col("last.seq").alias("l_seq"), F.col("last.id").alias("l_id"))
    begun = facts.select(F.lit(1).alias("b_kind"), F.col("bank_id").alias("b_bank"), F.col("id").alias("b_id"), F.col("seq").cast("long").alias("b_seq"), F.col("links").alias("b_links"), F.col("utility").alias("b_utility"))
    begun = begun.unionByName(notes.select(F.lit(0).alias("b_kind"), F.col("bank_id").alias("b_bank"), F.col("id").alias("b_id"), F.col("write_seq").alias("b_seq"), F.col("links").alias("b_links"), F.col("utility").alias("b_utility")))
    rooted = last.join(_merged(begun), F.col("l_bank").eqNullSafe(F.col("b_bank")) & (F.col("note_id") == F.col("b_id")) & (F.col("root_kind") == F.col("b_kind")) & (F.col("root_seq") == F.col("b_seq")))
    base = notes.groupBy(F.col("bank_id").alias("m_bank")).agg(F.max("write_seq").alias("base"))
    new = facts.join(_merged(rooted), F.col("bank_id").eqNullSafe(F.col("l_bank")) & (F.col("id") == F.col("l_id")) & (F.col("seq") == F.col("l_seq")))
    new = new.join(base, F.col("bank_id").eqNullSafe(F.col("m_bank")), "left")
    own = {"id": F.col("note_id"), "links": F.col("b_links"), "utility": F.col("b_utility"), "write_seq": F.coalesce("base", F.lit(0)) + 1 + F.col("seq")}
    new = new.select(*[own.get(c, F.col(c)).cast(notes.schema[c].dataType).alias(c) for c in notes.columns])
    over = rooted.where("root_kind = 0").select(F.col("l_bank").alias("o_bank"), F.col("note_id").alias("o_id"))
    return notes.join(_merged(over), F.col("bank_id").eqNullSafe(F.col("o_bank")) & (F.col("id") == F.col("o_id")), "left_anti").unionByName(new)
