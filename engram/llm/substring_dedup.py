"""Substring dedup: words covered by a window of words that starts anywhere else as well are removed.

Windows are routed so that equal ones meet: the anchor of a window is the least hash among its runs of ANCHOR words, and a
maximal run of windows with one anchor is a segment. Anchors are counted over all documents; a segment whose anchor occurs once
can hold no repeated window and goes no further. The others go to shards by anchor, each distinct segment once with how often it
occurs. A shard builds a compressed FM-index (fm_index) of its segments' words, streams all of them through it by backward search,
and reports the windows whose matches weigh two or more: a segment weighs as often as it occurs. If an anchor is too frequent, its segments are cut into single windows that
are routed by their own hash, so that neither copies nor contexts of a common passage gather in one shard. In a shard words are
compared as such; hashes only route segments and fold equal ones (128 bits of the segment's text).

Null and odd input: a null or blank text has no words; fewer words than a window are kept whole; repeated rows repeat
each other's windows; texts that repeat within themselves count as well; null doc_ids are documents; an empty table gives an
empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import documents, integer_ids, shuffle_partitions, written
from engram.llm.fm_index import FmIndex
from engram.llm.jaccard_join import _levels, level_of
from engram.llm.shingles import hashes_of, mixed, rolled, texts

WINDOW = 35
#: A run of windows with one anchor is cut after so many; an anchor with more segments than this, and than half a shard has on
#: average, is routed by window.
LONGEST_RUN, FREQUENT = 256, 1024
#: Shards for each shuffle partition; segments searched at once.
SHARDS, AT_ONCE = 4, 20_000
_EMPTY = np.empty(0, dtype=np.int64)


def anchor_words(window: int) -> int:
    return max(1, window // 4)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Segments:
    """The words of some texts one after another, and the segments of their windows."""

    def __init__(self, data: list[bytes | None], window: int):
        cut = [x.split() if x else [] for x in data]
        self.words = [w for words in cut for w in words]
        sizes = np.array([len(words) for words in cut], dtype=np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.hashes = hashes_of(self.words)
        m = anchor_words(window)
        self.grams = rolled(self.hashes, m)
        slots = window - m + 1
        if len(self.grams) < slots:
            self.start = self.size = self.doc = _EMPTY
            self.anchor = np.empty(0, dtype=np.uint64)
            return
        least = _least(self.grams, slots)
        valid = np.zeros(len(least) + 1, dtype=np.int8)
        for_windows = np.flatnonzero(sizes >= window)
        np.add.at(valid, self.first[for_windows], 1)
        np.add.at(valid, self.first[for_windows] + sizes[for_windows] - window + 1, -1)
        valid = np.cumsum(valid[:-1]).astype(bool)
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        starts = np.flatnonzero(new)
        last = valid.copy()
        last[:-1] &= ~valid[1:] | new[1:]
        size = np.flatnonzero(last) + 1 - starts
        parts = -(-size // LONGEST_RUN)
        if len(parts) and parts.max() > 1:
            offset = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            whole = np.repeat(size, parts)
            starts = np.repeat(starts, parts) + offset * LONGEST_RUN
            size = np.minimum(whole - offset * LONGEST_RUN, LONGEST_RUN)
        # Least hashes crowd at the low end; scrambled ones spread evenly over cells and shards.
        self.start, self.size, self.least, self.anchor = starts, size, least[starts], mixed(least[starts])
        self.doc = np.searchsorted(self.first + sizes, starts, side="right")
        self.slots = slots

    def counts(self) -> np.ndarray:
        """What each segment adds to its anchor's count: 2 if the anchor's words stand in it twice, as when a text repeats itself."""
        if not len(self.start):
            return self.start
        span = self.size + self.slots - 1
        offset = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
        same = self.grams[np.repeat(self.start, span) + offset] == np.repeat(self.least, span)
        return np.minimum(2, np.add.reduceat(same.astype(np.int64), np.cumsum(span) - span))


def _anchors(source: DataFrame, window: int) -> DataFrame:
    """(item, c): anchors that can hold a repeated window, and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, data in texts(b, 2):
                s = Segments(data, window)
                items, at = np.unique(s.anchor, return_inverse=True)
                c = np.bincount(at, weights=s.counts(), minlength=len(items)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(items.view(np.int64)), pa.array(c)], ["item", "c"])

    return source.mapInArrow(run, "item long, c long").groupBy("item").agg(F.sum("c").alias("c")).where("c > 1")


_PLACED = "doc_id long, row_key long, start int, fp binary, shard int, route long, words binary, c int"


def _segments(source: DataFrame, window: int, levels: np.ndarray, shards: int, frequent: float) -> DataFrame:
    """Places (doc_id, row_key, start, fp) of segments, and rows (fp, shard, route, words, c) of the distinct ones of a batch."""
    shared = source.sparkSession.sparkContext.broadcast(levels)
    names = ["doc_id", "row_key", "start", "fp", "shard", "route", "words", "c"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            for part, data in texts(b, 2, 2048):
                s = Segments(data, window)
                level = level_of(s.anchor, table)
                docs, keys, words = part.column(0).to_pylist(), part.column(1).to_pylist(), s.words
                rows, distinct = [], {}
                for k in np.flatnonzero(level > 0).tolist():
                    start, size, doc = int(s.start[k]), int(s.size[k]), int(s.doc[k])
                    pieces = [(start, size, int(s.anchor[k]))]
                    if 2 ** ((int(level[k]) - 1) / 4) > frequent:
                        own = mixed(rolled(s.hashes[start : start + size + window - 1], window)).tolist()
                        pieces = [(start + i, 1, route) for i, route in enumerate(own)]
                    for at, n, route in pieces:
                        text = b" ".join(words[at : at + n + window - 1])
                        fp = xxhash.xxh3_128_digest(text)
                        rows.append((docs[doc], keys[doc], at - int(s.first[doc]), fp, None, None, None, None))
                        seen = distinct.get(fp)
                        if seen:
                            seen[2] += 1
                        else:
                            distinct[fp] = [route, text, 1]
                rows += [(None, None, None, fp, route % shards, route - (1 << 63), text, c) for fp, (route, text, c) in distinct.items()]
                columns = zip(*rows, strict=True) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names)

    return source.mapInArrow(run, _PLACED)


def _searched(window: int):
    def shard(frame: pd.DataFrame) -> pd.DataFrame:
        """(fp, repeated): a byte for each window of the shard's segments that have any repeated one."""
        # A route that one segment alone takes, once, was let through by a full table only: it meets nothing. (If that segment
        # repeats itself, the anchor stands in it twice, and only a look at its windows can tell.)
        taken = frame.groupby("route")["c"].transform("sum").to_numpy()
        kept: dict[bytes, list] = {}
        for fp, text, c, n in zip(frame["fp"], frame["words"], frame["c"], taken, strict=True):
            if n > 1 or _repeats_itself(bytes(text).split(), window):
                seen = kept.setdefault(bytes(fp), [text, 0])
                seen[1] += c
        if not kept:
            return pd.DataFrame({"fp": [], "repeated": []})
        code: dict[bytes, int] = {}
        pieces = [np.array([code.setdefault(w, len(code) + 1) for w in bytes(text).split()], dtype=np.int64) for text, _ in kept.values()]
        sizes = np.array([len(p) + 1 for p in pieces])
        text = np.concatenate([x for p in pieces for x in (p, _END)])
        index = FmIndex(text, window, np.repeat(np.array([c for _, c in kept.values()]), sizes))
        every, out = list(zip(kept, pieces, strict=True)), {"fp": [], "repeated": []}
        for at in range(0, len(every), AT_ONCE):
            part = every[at : at + AT_ONCE]
            for (fp, _), weight in zip(part, index.matching([p for _, p in part]), strict=True):
                if (weight > 1).any():
                    out["fp"].append(fp)
                    out["repeated"].append((weight > 1).tobytes())
        return pd.DataFrame(out)

    return shard


_END = np.zeros(1, dtype=np.int64)


def _repeats_itself(words: list[bytes], window: int) -> bool:
    """Whether words could hold a window twice: some run of anchor length stands in them twice."""
    m = anchor_words(window)
    runs = [tuple(words[i : i + m]) for i in range(len(words) - m + 1)]
    return len(set(runs)) < len(runs)


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(source, found): source has (doc_id, row_key, text), found (doc_id, row_key, start, repeated) of segments."""
    source = integer_ids(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    anchors, shards = written(_anchors(source, window), "anchors"), SHARDS * shuffle_partitions(docs.sparkSession)
    total = anchors.agg(F.sum("c")).first()[0] or 0
    placed = written(_segments(source, window, _levels(anchors), shards, max(FREQUENT, total / shards / 2)), "segments")
    # Folded over all batches before the shards: a passage of every document reaches its shard once.
    distinct = placed.where("shard IS NOT NULL").groupBy("shard", "route", "fp").agg(F.first("words").alias("words"), F.sum("c").alias("c"))
    found = written(distinct.groupBy("shard").applyInPandas(_searched(window), "fp binary, repeated binary"), "repeated")
    # Rows alike in id and text have the same places: once is enough for all of them.
    places = placed.where("start IS NOT NULL").select("doc_id", "row_key", "start", "fp").distinct()
    return source, places.join(found, "fp").select("doc_id", "row_key", "start", "repeated")


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of docs; kept: the words that stay, joined by one space."""
    source, found = repeated_windows(docs, window)
    by_doc = found.groupBy("row_key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id")).agg(F.collect_list(F.struct("start", "repeated")).alias("found"))
    keyed = source.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    joined = keyed.join(by_doc, ["row_key", "id"], "left").select("doc_id", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data in texts(b, 1):
                total, gone, kept = [], [], []
                for x, ranges in zip(data, part.column(2).to_pylist(), strict=True):
                    words = x.split() if x else []
                    total.append(len(words))
                    if ranges:
                        edges = np.zeros(len(words) + 1, dtype=np.int64)
                        for r in ranges:
                            at = r["start"] + np.flatnonzero(np.frombuffer(r["repeated"], np.uint8))
                            np.add.at(edges, at, 1)
                            np.add.at(edges, at + window, -1)
                        stays = np.cumsum(edges[:-1]) == 0
                        words = [words[k] for k in np.flatnonzero(stays).tolist()]
                    gone.append(total[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
