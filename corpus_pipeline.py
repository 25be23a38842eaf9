"""The corpus pipeline: language ID, exact dedup, n-gram Jaccard join, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents:

* language_id drops what has no identifiable language: null texts, texts without a letter, and those whose best language
  has less than half of the score.
* exact_dedup keeps one of each group of equal texts, that with the largest doc_id.
* jaccard_join keeps one of each component of near duplicates (five words, similarity 0.8), that with the smallest doc_id.
* mix_sources repeats each document as often as the mix takes it whole, and cuts the one at the end of a source's share;
  what the mix does not take goes.
* bpe_encode gives (doc_id, n_tokens, ids_sha256, decoded_sha256) of each row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from engram.llm import bpe, exact_dedup, jaccard_join, lang_id, mixing
from engram.llm.common import delete, documents, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_id.keep_identified(docs, lang_id.train(docs, ~lang_id.held_out()))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, bpe.vocabulary_text())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", dedup_exact),
    ("jaccard_join", dedup_near),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]

#: Fingerprints, shingles and token ids have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        done = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            delete(spark, docs)
        docs = done
    return docs
