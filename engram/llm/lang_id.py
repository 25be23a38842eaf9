"""Language identification by word-first backoff.

The model is counted by Spark over labelled documents: how often each word, and each character n-gram of a padded word,
occurs in each language. To bound the model, training takes about SAMPLE documents of each language (all of a smaller one;
a hash of the id decides, of the text where there is no id), and keeps the WORDS most frequent words and GRAMS most frequent n-grams of
each length of a language, or fewer of each where many languages would make it more than PIECES in all. So whatever the corpus, the driver
gets a row a language and PIECES rows, ranked and cut by Spark, and broadcasts a model of that size. Every language of the labelled rows is
learned, however rare; more than MOST_LANGUAGES of them, several times as many as are written, are an error.

A word known in any language scores by its log frequency in each. An unseen word backs off: the longest n for which any of
its n-grams is known decides, by the mean log frequency of these n-grams, weighted below a known word. The language with
the greatest sum wins (ties: the first in code-point order); the score is its share of the exponentiated sums.

Null and odd input: a null text, or one without a letter, is `und` with score 0. So is every text if nothing could be
learned. A text of which no piece is known goes to the most frequent language, with score 1 / languages. Rows with a null
lang are not learned from; repeated rows count as often as they occur; null doc_ids are never held out. An empty table
gives an empty result. Only doc_id, text and lang are read, and lang only for training.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.llm.bpe import parts
from engram.llm.common import claim, documents, give_back, integer_ids

SAMPLE, WORDS, GRAMS, MAX_N = 2000, 10_000, 10_000, 5
PIECES, MOST_LANGUAGES = 1_000_000, 50_000
#: An unseen word counts this much of a known one; what a language lacks has this count.
UNSEEN, LACKING = 0.5, 0.5
#: Scores of tokens kept in a worker: at most so many tokens, and numbers in all.
REMEMBERED, NUMBERS = 100_000, 20_000_000
#: Texts that are in work at once.
AT_ONCE = 512
#: Marks around a token that are no part of its words.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LETTER = regex.compile(r"\p{L}")
LETTERS = regex.compile(r"[\p{L}\p{M}'’]+")


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def pieces(token: str) -> list[str]:
    """The words of a blank-separated token."""
    return [w for w in LETTERS.findall(token.lower()) if LETTER.search(w)]


def grams(word: str, n: int) -> list[str]:
    padded = f"_{word}_"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text, times) -> counts of words (n = 0) and n-grams by language."""
    names, types = ["lang", "n", "piece", "c"], (pa.int32(), pa.int32(), pa.string(), pa.int64())
    claim("lang_id", _models.clear)
    for whole in batches:
        for b in parts(whole):
            words: dict[int, Counter] = {}
            for lang, text, times in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tokens = words.setdefault(lang, Counter())
                for t, c in Counter(text.split()).items():
                    for w in pieces(t):
                        tokens[w] += c * times
            rows = []
            for lang, tokens in words.items():
                found = {n: Counter() for n in range(1, MAX_N + 1)}
                for w, c in tokens.items():
                    rows.append((lang, 0, w, c))
                    for n in found:
                        for g in grams(w, n):
                            found[n][g] += c
                rows += [(lang, n, g, c) for n, counts in found.items() for g, c in counts.items()]
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            del words, rows, columns
            give_back(collect=False)


class Model:
    """Log frequencies of words (n = 0) and n-grams in each language."""

    def __init__(self, languages: list[str], shares: list[float], rows: pa.Table | list[tuple[int, int, str, int]], totals: dict[tuple[int, int], int]):
        """rows (lang, n, piece, c): how often a language, by its place in ``languages``, has a piece."""
        self.languages = languages
        self.common = int(np.argmax(shares)) if shares else 0
        if not isinstance(rows, pa.Table):
            rows = pa.table(dict(zip(("lang", "n", "piece", "c"), zip(*rows, strict=True), strict=True)) if rows else {k: [] for k in ("lang", "n", "piece", "c")})
        #: By n: the row of each piece. A row is sparse: what each language that has the piece scores above the floor of n.
        self.index: list[dict[str, int]] = []
        begin, columns, above, floors, counts_of = 1, [], [], [np.zeros(1)], [np.zeros(1, np.int64)]
        self.begin = [begin]
        for n in range(MAX_N + 1):
            own = rows.filter(pc.equal(rows["n"], n)).sort_by([("piece", "ascending"), ("lang", "ascending")])
            code = own["lang"].to_numpy().astype(np.int64)
            total = np.array([max(totals.get((k, n), 0), 1.0) for k in range(len(languages))])
            # One floor for all languages, so that one with few training words gains nothing by what it lacks.
            floor = np.log(LACKING / total.max(initial=1.0))
            by_piece = pc.run_end_encode(own["piece"].combine_chunks())
            self.index.append({piece: row for row, piece in enumerate(by_piece.values.to_pylist())})
            columns.append(code)
            above.append(np.log(own["c"].to_numpy().astype(np.float64) / total[code]) - floor)
            counts_of.append(np.diff(by_piece.run_ends.to_numpy().astype(np.int64), prepend=0))
            floors.append(np.full(len(counts_of[-1]), floor))
            begin += len(counts_of[-1])
            self.begin.append(begin)
        #: All rows: where each ends, which languages it has, what they score above its floor.
        self.ends = np.cumsum(np.concatenate(counts_of))
        self.columns, self.above, self.floors = np.concatenate(columns), np.concatenate(above), np.concatenate(floors)
        self.remembered = max(1, min(REMEMBERED, NUMBERS // max(1, len(languages))))
        self.forget()

    def forget(self) -> None:
        """Tokens and words with the rows of their scores; row 0 is a token without a word."""
        self._known: dict[str, int] = {}
        self._words: dict[str, int] = {}
        self._rows = np.zeros((1, len(self.languages)))

    def word(self, w: str) -> list[int]:
        """The rows of the table whose mean is a word's score: its own, or those of its longest known n-grams."""
        known = self.index[0].get(w)
        if known is not None:
            return [self.begin[0] + known]
        padded = f"_{w}_"
        for n in range(min(MAX_N, len(padded)), 0, -1):
            index, begin = self.index[n], self.begin[n]
            hits = [begin + index[g] for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in index]
            if hits:
                return hits
        return []

    def _learn(self, tokens: set[str]) -> None:
        """Scores of tokens not known yet: those of their words, each of which is scored once."""
        words = {t: [w.lower()] if (w := t.strip(MARKS)).isalpha() else pieces(t) for t in tokens}
        new = list({w for own in words.values() for w in own} - self._words.keys())
        hits = [self.word(w) for w in new]
        self._words.update(zip(new, range(len(self._rows), len(self._rows) + len(new)), strict=True))
        weights = [(1.0 if found[0] < self.begin[1] else UNSEEN) / len(found) if found else 0.0 for found in hits]
        self._rows = np.concatenate([self._rows, self._scores(hits, weights)])
        several = [t for t, own in words.items() if len(own) > 1]
        self._known.update((t, self._words[own[0]] if own else 0) for t, own in words.items() if len(own) < 2)
        if several:
            sizes = [len(words[t]) for t in several]
            sums = np.add.reduceat(self._rows[[self._words[w] for t in several for w in words[t]]], np.cumsum(sizes) - sizes, axis=0)
            self._known.update(zip(several, range(len(self._rows), len(self._rows) + len(several)), strict=True))
            self._rows = np.concatenate([self._rows, sums])

    def _scores(self, hits: list[list[int]], weights: list[float]) -> np.ndarray:
        """For each list of table rows their sum times its weight."""
        width, sizes = len(self.languages), np.array(list(map(len, hits)), dtype=np.int64)
        hit, owner = np.array([h for found in hits for h in found], dtype=np.int64), np.repeat(np.arange(len(hits)), sizes)
        weight = np.repeat(np.array(weights, dtype=np.float64), sizes)
        has = self.ends[hit] - self.ends[hit - 1]
        at = np.arange(has.sum()) + np.repeat(self.ends[hit] - np.cumsum(has), has)
        key = np.repeat(owner, has) * width + self.columns[at]
        above = np.bincount(key, weights=np.repeat(weight, has) * self.above[at], minlength=len(hits) * width).reshape(-1, width)
        return above + np.bincount(owner, weights=weight * self.floors[hit], minlength=len(hits))[:, None]

    def _rows_of(self, tokens: list[str]) -> np.ndarray:
        """The rows of scores of distinct tokens; they hold until the next call."""
        at = list(map(self._known.get, tokens))
        missing = {t for t, row in zip(tokens, at, strict=True) if row is None}
        if missing:
            if len(self._known) + len(missing) > self.remembered:
                self.forget()
                missing = set(tokens)
            self._learn(missing)
            at = list(map(self._known.__getitem__, tokens))
        return np.array(at, dtype=np.int64)

    def _sums(self, texts: list[str]) -> np.ndarray:
        """The scores of each text: the sums of its tokens', by languages. Distinct tokens are told apart for all texts at once, and as
        many of them looked up together as are remembered."""
        cut = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        coded, doc = cut.values.dictionary_encode(), np.repeat(np.arange(len(texts)), cut.value_lengths().to_numpy())
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        sums, most = np.zeros((len(texts), len(self.languages))), max(1, NUMBERS // max(1, len(self.languages)))
        for low in range(0, len(distinct), self.remembered):
            rows = self._rows_of(distinct[low : low + self.remembered])
            own = np.flatnonzero((codes >= low) & (codes < low + self.remembered)) if len(distinct) > self.remembered else np.arange(len(codes))
            for k in range(0, len(own), most):
                part = own[k : k + most]
                first = np.flatnonzero(np.diff(doc[part], prepend=-1))
                sums[doc[part[first]]] += np.add.reduceat(self._rows[rows[codes[part] - low]], first, axis=0)
        return sums

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        all_usable = [k for k, t in enumerate(texts) if t and self.languages and LETTER.search(t)]
        most = max(1, NUMBERS // max(1, len(self.languages)))
        for low in range(0, len(all_usable), most):
            usable = all_usable[low : low + most]
            sums = self._sums([texts[k] for k in usable])
            best = np.where(np.any(sums != 0, axis=1), np.argmax(sums, axis=1), self.common)
            share = np.exp(sums - sums.max(axis=1, keepdims=True))
            score = share[np.arange(len(best)), best] / share.sum(axis=1)
            for k, lang, x in zip(usable, best.tolist(), score.tolist(), strict=True):
                out[k] = (self.languages[lang], x)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def train(docs: DataFrame, labelled: Column) -> bytes:
    """The pickled model; only rows where ``labelled`` holds and lang is not null are learned from."""
    rows = docs.select("doc_id", "lang", "text").where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull())
    spark = docs.sparkSession
    per_lang = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(per_lang) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(r["lang"] for r in per_lang)
    n_docs = {r["lang"]: r["n"] for r in per_lang}
    if not languages:
        return pickle.dumps(Model([], [], [], {}))
    code = {lang: k for k, lang in enumerate(languages)}
    share = spark.createDataFrame([(r["lang"], code[r["lang"]], min(1.0, SAMPLE / r["n"])) for r in per_lang], "lang string, code int, share double")
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    lot = F.pmod(key, F.lit(1 << 20)) / float(1 << 20)
    sample = rows.join(F.broadcast(share), "lang").where(lot < F.col("share"))  # at most MOST_LANGUAGES rows
    # Texts that repeat are read once, so that a text with one lot for very many rows costs no more than its length.
    texts = sample.groupBy("code", "text").agg(F.count("*").alias("times"))
    counts = texts.mapInArrow(_count, "lang int, n int, piece string, c long").groupBy("lang", "n", "piece").agg(F.sum("c").alias("c"))
    best = W.partitionBy("lang", "n").orderBy(F.desc("c"), "piece")
    whole = W.partitionBy("lang", "n")
    each = max(1, PIECES // (len(languages) * (MAX_N + 1)))
    most = F.when(F.col("n") == 0, min(WORDS, each)).otherwise(min(GRAMS, each))
    top = counts.withColumn("total", F.sum("c").over(whole)).withColumn("k", F.row_number().over(best)).where(F.col("k") <= most)
    found = top.select("lang", "n", "piece", "c", "total").toArrow()  # at most PIECES rows, or MAX_N + 1 a language
    totals = found.group_by(["lang", "n"]).aggregate([("total", "max")])
    totals = {(r["lang"], r["n"]): r["total_max"] for r in totals.to_pylist()}
    return pickle.dumps(Model(languages, [n_docs[x] for x in languages], found, totals))


_models: dict[int, Model] = {}


def _loaded(model: bytes) -> Model:
    """One model for each Python worker."""
    claim("lang_id", _models.clear)
    key = hash(model)
    if key not in _models:
        _models.clear()
        _models[key] = pickle.loads(model)
    return _models[key]


def _predicted(batches: Iterator[pa.RecordBatch], at: int, model: bytes) -> Iterator[tuple[pa.RecordBatch, list[tuple[str, float]]]]:
    """The rows in parts, with (language, score) of each row's text, the column ``at``."""
    known = _loaded(model)
    for whole in batches:
        for b in parts(whole, AT_ONCE):
            yield b, known.predict_all(b.column(at).to_pylist())
            give_back(collect=False)  # else the pools keep several times what is in work


def predict(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, lang_pred, score) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _predicted(batches, 1, shared.value):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return integer_ids(docs.select("doc_id", "text"), "doc_id").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: bytes, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is not `und` and scores at least ``least``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    integer_ids(docs, "doc_id")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _predicted(batches, at, shared.value):
            yield b.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, train(docs, ~held_out())).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
