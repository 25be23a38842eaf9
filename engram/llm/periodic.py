"""Periodic runs of words, and texts with what a run repeats taken out.

A run is a stretch of words with smallest period q and at least max(12, 2 q) words that cannot be extended. Words q apart that are
equal are a match of lag q; a run has max(12 - q, q) matches in a row, an island, so a lag with fewer matches in all holds no run.
Matches of every lag are counted at once, heavy and light: for frequent words by an exact autocorrelation, whose power spectra
are summed up and transformed back once, for rare words by the differences of all pairs of their places. Only lags with
enough matches are scanned for islands. Two things keep this short and lose nothing: a place takes part only if a sequence of
six words around it occurs twice (every place of a run is in one), and a run found at lag q takes its matches at the
multiples of q away from their counts, as there it would be found again with a period that is not its smallest.

Words are compared by codes that stand for their bytes; hashes only say where a look is worth while. A document is a row and is
worked on whole, whatever its length: time grows with n^1.5 at worst for the counts.

Null and odd input: a null or blank text has no words and no runs; a null doc_id is a document that is taken as it is; repeated
rows go through one by one; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from engram.llm.common import documents, integer_ids
from engram.llm.shingles import mixed, rolled

SHORTEST, GRAM = 12, 6
#: Bytes of texts in work at once (one text at least).
AT_ONCE = 1 << 21
#: A word is heavy if its pairs are more than so many times the steps of a transform.
HEAVY = 4
Run = tuple[int, int, int]


def varied(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document as they are judged: one in ten documents, by the checksum of its id, gets a periodic tail."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * (-(-(n - a) // p)))[: n - a]


def least_matches(q: int | np.ndarray) -> int | np.ndarray:
    return np.maximum(SHORTEST - q, q)


def _live(codes: np.ndarray) -> np.ndarray:
    """Places within a sequence of GRAM words that occurs more than once."""
    grams = rolled(codes.astype(np.uint64), GRAM)
    _, at, count = np.unique(grams, return_inverse=True, return_counts=True)
    edges = np.zeros(len(codes) + 1, dtype=np.int64)
    starts = np.flatnonzero(count[at] > 1)
    edges[starts] += 1
    edges[starts + GRAM] -= 1
    return np.cumsum(edges[:-1]) > 0


def matches(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many of the places have an equal word each lag later that is one of them too, for lags 0 to len(codes) // 2."""
    n, most = len(codes), len(codes) // 2
    counts = np.zeros(most + 1, dtype=np.int64)
    order = np.argsort(codes[places], kind="stable")
    at, word = places[order], codes[places][order]
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    size = np.diff(np.append(first, len(word)))
    length = 1 << int(2 * n - 1).bit_length()
    heavy = size * (size - 1) // 2 > HEAVY * length * length.bit_length()
    if heavy.any():
        power = np.zeros(length // 2 + 1)
        for start, many in zip(first[heavy].tolist(), size[heavy].tolist(), strict=True):
            there = np.zeros(length)
            there[at[start : start + many]] = 1.0
            f = np.fft.rfft(there)
            power += f.real**2 + f.imag**2
        counts += np.rint(np.fft.irfft(power, length)[: most + 1]).astype(np.int64)
    last = np.repeat(np.where(heavy, 0, first + size), size)  # a light word's end
    left, step = np.flatnonzero(np.arange(len(word)) + 1 < last), 1
    while len(left):
        lag = at[left + step] - at[left]
        counts += np.bincount(lag[lag <= most], minlength=most + 1)
        step += 1
        left = left[(left + step < last[left])]
    return counts


def runs(codes: np.ndarray) -> list[Run]:
    """(start, length, period) of all runs, by start, then period."""
    n = len(codes)
    if n < SHORTEST:
        return []
    places = np.flatnonzero(_live(codes))
    if not len(places):
        return []
    counts = matches(codes, places)
    lags = np.arange(len(counts))
    found: dict[tuple[int, int], int] = {}
    for q in (np.flatnonzero(counts[1:] >= least_matches(lags[1:])) + 1).tolist():
        least = int(least_matches(q))
        if counts[q] < least:  # what was counted has been found with a smaller period
            continue
        same = np.zeros(n - q + 2, dtype=np.int8)
        same[1:-1] = codes[:-q] == codes[q:]
        turns = np.diff(same)
        starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        long = ends - starts >= least
        for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            length = end - start + q
            if (start, length) not in found:
                found[start, length] = q
                again = lags[2 * q : length // 2 + 1 : q]
                counts[again] -= length - again
    return sorted((start, length, q) for (start, length), q in found.items())


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in found:
        edges[start + q] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def _worth(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which texts may hold a run: those in which a sequence of GRAM words occurs twice."""
    out = np.zeros(len(sizes), dtype=bool)
    grams = rolled(codes.astype(np.uint64), GRAM)
    if len(grams):
        doc = np.repeat(np.arange(len(sizes)), sizes)
        inside = doc[: len(grams)] == doc[GRAM - 1 :]
        doc = doc[: len(grams)][inside]
        key = mixed(grams[inside] ^ mixed(doc.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        again = np.flatnonzero(key[order][1:] == key[order][:-1])
        out[doc[order[again]]] = True
    return out


def every_run(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text, given as words."""
    number: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), dtype=np.int64, count=int(sizes.sum()))
    ends = np.cumsum(sizes)
    worth = _worth(codes, sizes)
    return [runs(codes[end - size : end]) if look else [] for end, size, look in zip(ends.tolist(), sizes.tolist(), worth.tolist(), strict=True)]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of a batch whose texts take about AT_ONCE bytes, and those texts."""
    sizes = batch.column(1).cast(pa.binary()).to_pylist()
    at = 0
    while at < len(sizes):
        end, taken = at, 0
        while end < len(sizes) and (end == at or taken + len(sizes[end] or b"") <= AT_ONCE):
            taken += len(sizes[end] or b"")
            end += 1
        yield batch.slice(at, end - at), sizes[at:end]
        at = end


_OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def detect(docs: DataFrame, vary: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs, collapsed) for each row of docs; start to
    exponent_milli are of the longest run. vary: judge each text with the periodic tail that its id gives it."""
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])), pa.string()]
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, data in _parts(whole):
                ids = b.column(0).to_pylist()
                texts = [x.split() if x else [] for x in data]  # bytes know the six ASCII blanks only
                if vary:
                    texts = [varied(t, i) for t, i in zip(texts, ids, strict=True)]
                rows = []
                for i, words, found in zip(ids, texts, every_run(texts), strict=True):
                    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
                    listing = "".join(f"{s},{n},{q}\n" for s, n, q in found)
                    kept = b" ".join(collapsed(words, found))
                    milli = 1000 * best[1] // best[2] if found else None
                    shas = [hashlib.sha256(x).hexdigest() for x in (listing.encode(), kept)]
                    rows.append((i, len(found), *best, milli, *shas, [{"start": s, "length": n, "period": q} for s, n, q in found], kept.decode()))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return integer_ids(docs.select("doc_id", "text"), "doc_id").mapInArrow(run, _OUT)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(documents(spark, sf_dir), vary=True).drop("runs", "collapsed")


OP12_SQL = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, doc_id::VARCHAR AS s FROM documents),
hashed AS (
  SELECT rid, doc_id, w, len(w) AS n, xor(list_reduce(list_concat([4294967295], range(8 * len(s))), lambda c, i:
    xor(CASE WHEN i % 8 = 0 THEN xor(c, ord(s[i // 8 + 1])::BIGINT) ELSE c END >> 1,
        CASE WHEN CASE WHEN i % 8 = 0 THEN xor(c, ord(s[i // 8 + 1])::BIGINT) ELSE c END % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) AS h FROM texts),
placed AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM hashed),
varied AS (
  SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM placed),
tokens AS (SELECT rid, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM varied),
numbered AS MATERIALIZED (SELECT rid, n, i, word, dense_rank() OVER (ORDER BY word) AS c FROM tokens),
grams AS MATERIALIZED (SELECT * FROM (SELECT rid, n, i, {", ".join(f"lead(c, {k}) OVER w AS c{k}" for k in range(GRAM))} FROM numbered WINDOW w AS (PARTITION BY rid ORDER BY i)) WHERE c{GRAM - 1} IS NOT NULL),
pairs AS (SELECT x.rid, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.rid = y.rid AND {" AND ".join(f"x.c{k} = y.c{k}" for k in range(GRAM))} AND x.i < y.i AND 2 * (y.i - x.i) <= x.n),
islands AS (SELECT rid, q, min(i) AS start, count(*) + {GRAM - 1} + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM pairs) GROUP BY rid, q, island),
found AS MATERIALIZED (SELECT rid, start, length, min(q) AS period FROM islands WHERE length >= greatest({SHORTEST}, 2 * q) GROUP BY ALL),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM found),
kept AS (SELECT t.rid, string_agg(word, ' ' ORDER BY t.i) AS kept FROM numbered t ANTI JOIN gone g ON g.rid = t.rid AND g.i = t.i GROUP BY t.rid),
listed AS (
  SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listing,
    first({{'start': start, 'length': length, 'period': period}} ORDER BY length DESC, start, period) AS best FROM found GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
  (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(listing, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM varied v LEFT JOIN listed l ON l.rid = v.rid LEFT JOIN kept k ON k.rid = v.rid"""
