"""An inverted index of keywords and tags: which notes have a word, and how many do.

Postings are rows (kind, word, n, bank_id, id, write_seq), words in lower case, sorted by kind and word, so a saved index is read by its files'
statistics; n is the number of notes with the word. Filters and write decisions read postings alone, never a note's text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("keywords", "tags")


def build(notes: DataFrame) -> DataFrame:
    """notes (bank_id, id, write_seq, keywords, tags) -> postings; a word of a note counts once."""
    lists = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_distinct(F.transform(k, F.lower)).alias("words")) for k in KINDS])
    rows = notes.select("bank_id", "id", "write_seq", F.explode(lists).alias("l")).select("bank_id", "id", "write_seq", "l.kind", F.explode("l.words").alias("word")).where("word IS NOT NULL")
    counts = rows.groupBy("kind", "word").agg(F.count("*").alias("n"))
    return rows.join(counts, ["kind", "word"]).select("kind", "word", "n", "bank_id", "id", "write_seq")


def save(postings: DataFrame, path: str) -> None:
    postings.repartitionByRange("kind", "word", "bank_id", "id").sortWithinPartitions("kind", "word", "bank_id", "id").write.option("parquet.bloom.filter.enabled#word", "true").parquet(path)


def extended(postings: DataFrame, changed: DataFrame) -> DataFrame:
    """postings after a write: those of changed notes (their new rows, as in build) take the place of their old ones."""
    gone = changed.select(F.col("bank_id").alias("g_bank"), F.col("id").alias("g_id")).distinct()
    kept = postings.join(gone, F.col("bank_id").eqNullSafe(F.col("g_bank")) & (F.col("id") == F.col("g_id")), "left_anti").drop("n")
    rows = kept.unionByName(build(changed).drop("n"))
    return rows.join(rows.groupBy("kind", "word").agg(F.count("*").alias("n")), ["kind", "word"]).select("kind", "word", "n", "bank_id", "id", "write_seq")


def _having(postings: DataFrame, kind: str, words: Iterable[str]) -> DataFrame:
    return postings.where((F.col("kind") == kind) & F.col("word").isin(*{w.lower() for w in words}))


def matching(postings: DataFrame, keywords: Iterable[str] = (), tags: Iterable[str] = ()) -> DataFrame:
    """(bank_id, id) of notes with one of the keywords and one of the tags, in any case; of what is not asked for, any. The rarer side
    is read first and the other one semi-joined to it: the counts of the words asked for tell which."""
    asked = [(k, _having(postings, k, w)) for k, w in (("keywords", list(keywords)), ("tags", list(tags))) if w]
    if not asked:
        return postings.select("bank_id", "id").distinct()
    if len(asked) > 1:
        size = {k: rows.select("word", "n").distinct().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for k, rows in asked}
        asked.sort(key=lambda a: size[a[0]])
    out = asked[0][1].select("bank_id", "id").distinct()
    for _, rows in asked[1:]:
        other = rows.select(F.col("bank_id").alias("o_bank"), F.col("id").alias("o_id"))
        out = out.join(other, F.col("bank_id").eqNullSafe(F.col("o_bank")) & (F.col("id") == F.col("o_id")), "left_semi")
    return out


def bank_keywords(postings: DataFrame) -> DataFrame:
    """(id, write_seq, keyword), as ``write_ops.decide`` takes a bank."""
    return postings.where("kind = 'keywords'").select("id", "write_seq", F.col("word").alias("keyword"))
