"""Jaccard self-join of documents on word shingles: size-aware, heavy and light.

Documents of equal shingle sets are one class. Shingles have one global order: those of a window of the hash space come
first, by how many documents have them (of all documents; items outside the window are not counted), then by hash. Two sets that overlap in at least
c = ceil(t * size) share an item among the first size - c + 1 of each, and two items among the first size - c + 2.

* Heavy: a larger set goes into the inverted list of each item of that prefix, and lists are scanned.
* Light: a smaller set is listed under each subset of two items of the longer prefix instead, so lists are short.

The boundary between them is the size at which the rows of the subsets cost as much as the rows and the expected scans of
the lists. Sets near the boundary do both, so no pair falls between. An item that one document alone has links nothing and is
not listed. A list that may be long, by its item's count, is spread over pairs of blocks; so is a list of an item that was not
counted, by the number of its members.

Listings carry no more than a class's fingerprint; profiles follow to the members of lists that have two classes.

Scanning a list compares sizes and profiles (for each of 8 * PROFILE cells whether the number of items in it is odd: two sets
differ in at least as many items as their profiles in bits), which never rules out a true pair, and emits a spanning forest of
what remains, not all pairs. The forest's edges are verified on the full sets. Where an edge
fails, the lists that it came from are scanned again for every remaining pair between different components, and those are
verified too; so the components are those of all links.

Null and odd input: a null or blank text has an empty set, size 0, and links with nothing; fewer than n words are one shingle;
repeated rows are equal sets; a null doc_id is a document but never a component's id unless it has no other; an empty table
gives an empty result. Only doc_id and text are read; ``one_of_each`` carries all other columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import delete, documents, integer_ids, release, written
from engram.llm.components import components
from engram.llm.filters import may_hold, row_filter
from engram.llm.shingles import mixed, shingle_set, texts

WORDS, THRESHOLD = 5, Fraction(4, 5)
#: Bytes of a profile; members of a list that are compared in one place.
PROFILE, BLOCK = 64, 4096
#: The only things broadcast: a table of counts of a byte for each of at most 2^LEVEL_BITS cells (16 cells for each item counted,
#: as far as that goes), and a filter of wanted documents (filters).
LEVEL_BITS = 25
#: Classes that a task remembers to list them once.
SEEN = 1 << 19
#: Cost of a row, and of one comparison in a list's scan; the most items of which subsets are taken.
ROW, SCAN, MOST_ITEMS = 1.0, 0.02, 24
OUTSIDE = 255
#: The block of a list whose length is not known before its members are counted; no other list has so many blocks.
OPEN = 1 << 30


def window(t: Fraction) -> float:
    """The share of the hash space whose items are counted and come first: half as much again as the prefix takes."""
    return min(1.0, 1.5 * float(1 - t) + 0.02)


def in_window(items: np.ndarray, t: Fraction) -> np.ndarray:
    return (items & np.uint64(0xFFFFFFFF)) < np.uint64(int(window(t) * (1 << 32)))


def _counted(source: DataFrame, n: int, t: Fraction) -> DataFrame:
    """(item, c) for the items of the window that at least two documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, data in texts(b, 1):
                sets = [s[in_window(s, t)] for s in (shingle_set(x, n) for x in data)]
                items, c = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(items.view(np.int64)), pa.array(c)], ["item", "c"])

    return source.mapInArrow(run, "item long, c long").groupBy("item").agg(F.sum("c").alias("c")).where("c > 1")


def _levels(counts: DataFrame) -> np.ndarray:
    """A byte for each cell of the hash space: the greatest count there on a log scale, 0 for none."""
    bits = min(LEVEL_BITS, max(12, (16 * counts.count()).bit_length()))
    cell = F.shiftrightunsigned("item", 64 - bits)
    level = F.least(F.lit(OUTSIDE - 1), F.lit(1) + F.floor(F.log2("c") * 4)).cast("int")
    cells = counts.select(F.shiftright(cell, 12).cast("int").alias("page"), (cell % 4096).cast("int").alias("at"), level.alias("level"))

    def page(frame: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(4096, dtype=np.uint8)
        np.maximum.at(out, frame["at"].to_numpy(), frame["level"].to_numpy(dtype=np.uint8))
        return pd.DataFrame({"page": [int(frame["page"].iloc[0])], "levels": [out.tobytes()]})

    cells = cells.groupBy("page", "at").agg(F.max("level").alias("level"))
    table = np.zeros(1 << bits, dtype=np.uint8)
    for r in cells.groupBy("page").applyInPandas(page, "page int, levels binary").toArrow().to_pylist():  # as large as the table
        table[r["page"] * 4096 : (r["page"] + 1) * 4096] = np.frombuffer(r["levels"], np.uint8)
    return table


def level_of(items: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return levels[(items >> np.uint64(65 - len(levels).bit_length())).astype(np.int64)]


def boundary(mean_list: float, t: Fraction) -> int:
    """The greatest size at which subsets cost no more than lists, with lists of this mean length."""
    items = 1
    while items < MOST_ITEMS and items * (items + 1) / 2 * ROW <= items * (ROW + mean_list * SCAN):
        items += 1
    return int(items / float(1 - t))


def least_light(t: Fraction) -> int:
    """The least size at which any linked set shares two items, as subsets need."""
    size = 1
    while -(-t.numerator * size // t.denominator) < 2:
        size += 1
    return size


def prefix(items: np.ndarray, levels: np.ndarray, t: Fraction, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """The first size - ceil(t * size) + extra items of a sorted set in the global order, with their levels."""
    size = len(items)
    take = min(size, size - -(-t.numerator * size // t.denominator) + extra)
    level = np.where(in_window(items, t), level_of(items, levels), OUTSIDE)
    order = np.lexsort((items, level))[:take]
    return items[order], level[order]


def _blocks(fp: bytes, level: int) -> list[int]:
    """The pairs of blocks, as single numbers, of a list's member; one block for a list that is short for sure."""
    if level == OUTSIDE:
        return [OPEN]
    most = 2 ** (level / 4) if level > 0 else 1
    m = -(-int(most) // BLOCK)
    if m <= 1:
        return [0]
    mine = int.from_bytes(fp[:4], "little") % m
    return [1 + min(mine, k) * m + max(mine, k) for k in range(m)]


_POSTINGS = "doc_id long, row long, fp binary, n int, profile binary, key long, block int"


def _postings(source: DataFrame, n: int, t: Fraction, levels: np.ndarray, light: int) -> DataFrame:
    """A row for each document (key and profile null), and for each class that a task meets its profile (key null) and its
    listings. ``row`` is a hash of the text: null ids, and ids used again, have one too."""
    shared = source.sparkSession.sparkContext.broadcast(levels)
    least = least_light(t)
    names, types = ["doc_id", "row", "fp", "n", "profile", "key", "block"], [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int32()]

    def listings(items: np.ndarray, fp: bytes, table: np.ndarray) -> Iterator[tuple[int, int]]:
        size = len(items)
        if least <= size <= light:
            first, level = prefix(items, table, t, 2)
            first, level = first[level > 0], level[level > 0]
            i, j = np.triu_indices(len(first), 1)
            low, high = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
            keys = mixed(low * np.uint64(3) + mixed(high)).view(np.int64)
            for key, block_level in zip(keys.tolist(), np.minimum(level[i], level[j]).tolist(), strict=True):
                for block in _blocks(fp, block_level):
                    yield key, block
        if size * t.denominator > light * t.numerator or size * t.numerator < least * t.denominator:
            first, level = prefix(items, table, t, 1)
            for key, item_level in zip(first[level > 0].view(np.int64).tolist(), level[level > 0].tolist(), strict=True):
                for block in _blocks(fp, item_level):
                    yield key, -block - 1  # below zero: a heavy list

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, set()
        for b in batches:
            for part, data in texts(b, 1):
                rows = []
                for doc, row, x in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), data, strict=True):
                    items = shingle_set(x, n)
                    if not len(items):
                        rows.append((doc, row, None, 0, None, None, None))
                        continue
                    fp = xxhash.xxh3_128_digest(items.tobytes())
                    rows.append((doc, row, fp, len(items), None, None, None))
                    if fp not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()  # a class that is listed twice is one class all the same
                        seen.add(fp)
                        cells = np.bincount((items % np.uint64(8 * PROFILE)).astype(np.int64), minlength=8 * PROFILE)
                        profile = np.packbits(cells & 1).tobytes()
                        rows.append((None, None, fp, len(items), profile, None, None))
                        rows += [(None, None, fp, None, None, key, block) for key, block in listings(items, fp, table)]
                columns = zip(*rows, strict=True) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names)

    return source.mapInArrow(run, _POSTINGS)


def _split(listed: DataFrame) -> DataFrame:
    """listed, with the open lists of more than BLOCK members spread over pairs of blocks."""
    is_open = F.col("block").isin(OPEN, -OPEN - 1)
    counts = listed.where(is_open).groupBy("key", "block").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK)
    long = written(counts.select("key", "block", F.ceil(F.col("c") / BLOCK).alias("m")), "long")
    if not long.limit(1).count():
        return listed
    mine = F.pmod(F.xxhash64("fp"), "m")
    pair = (1 + F.least(mine, "k") * F.col("m") + F.greatest(mine, "k")).cast("int")
    spread = listed.where(is_open).join(long, ["key", "block"], "left").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("m", F.lit(1)) - 1)))
    block = F.when(F.col("m").isNull(), F.col("block")).when(F.col("block") < 0, -pair - 1).otherwise(pair)
    # Written, so that a long list's rows are dealt anew by key and block.
    return listed.where(~is_open).unionByName(written(spread.withColumn("block", block).select(*listed.columns), "spread"))


def _live(listed: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, block, fp, n, profile): the listings of lists with two classes or more."""
    met = listed.groupBy("key", "block").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    profiles = classes.groupBy("fp").agg(F.first("n").alias("n"), F.first("profile").alias("profile"))
    return written(met.select("key", "block", F.explode("fps").alias("fp")).join(profiles, "fp").select("key", "block", "fp", "n", "profile"), "listed")


def _close(size: np.ndarray, profile: np.ndarray, i: int, others: np.ndarray, t: Fraction, above: int) -> np.ndarray:
    """Which others may reach the threshold with i: sizes and profiles allow it, and the light lists do not have the pair, which
    they do if both sizes lie between the least and ``above`` (0 in a light list)."""
    a, b = size[i], size[others]
    small, large = np.minimum(a, b), np.maximum(a, b)
    fits = (small * t.denominator >= large * t.numerator) & ((large > above) | (small < least_light(t)))
    k = np.flatnonzero(fits)
    apart = np.bitwise_count(profile[others[k]] ^ profile[i]).sum(axis=1, dtype=np.int64)
    fits[k] = apart * (t.denominator + t.numerator) <= (a + b[k]) * (t.denominator - t.numerator)
    return fits


def _forest(size: np.ndarray, profile: np.ndarray, t: Fraction, above: int) -> Iterator[tuple[int, int]]:
    left = np.argsort(size, kind="stable")
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            v = queue.pop()
            fits = _close(size, profile, v, left, t, above)
            for w in left[fits].tolist():
                yield v, w
                queue.append(w)
            left = left[~fits]


def _crossing(size: np.ndarray, profile: np.ndarray, label: list[bytes], t: Fraction, above: int) -> Iterator[tuple[int, int]]:
    codes = np.unique(np.array([x.hex() for x in label]), return_inverse=True)[1]
    for i in range(len(size) - 1):
        rest = np.arange(i + 1, len(size))
        rest = rest[codes[rest] != codes[i]]
        for w in rest[_close(size, profile, i, rest, t, above)].tolist():
            yield i, w


def _scan(lists: DataFrame, t: Fraction, light: int, labelled: bool) -> DataFrame:
    """(key, block, a, b): candidate pairs of the lists' classes, a < b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            members = b.column(2)
            flat = members.flatten()
            fps, size = flat.field("fp").to_pylist(), flat.field("n").to_numpy().astype(np.int64)
            profile = np.frombuffer(b"".join(flat.field("profile").to_pylist()), "<u8").reshape(-1, PROFILE // 8)
            label = flat.field("label").to_pylist() if labelled else None
            ends = np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False))
            out = []
            start = 0
            for key, block, end in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ends.tolist(), strict=True):
                own = list({fps[k]: k for k in range(start, end)}.values()) if end - start > 1 else []
                start = end
                above = light if block < 0 else 0
                if len(own) < 2:
                    continue
                at = np.array(own)
                found = _crossing(size[at], profile[at], [label[k] for k in own], t, above) if labelled else _forest(size[at], profile[at], t, above)
                for v, w in found:
                    x, y = fps[own[v]], fps[own[w]]
                    out.append((key, block, min(x, y), max(x, y)))
            columns = zip(*out, strict=True) if out else [[], [], [], []]
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "block", "a", "b"])

    return lists.mapInArrow(run, "key long, block int, a binary, b binary")


def _sets(source: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(fp, items) of the classes in wanted (fp, row): made again from the text of that row."""
    shared = source.sparkSession.sparkContext.broadcast(row_filter(wanted))
    hashed = source.select("row", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            ok = may_hold(table, b.column(0).to_numpy().view(np.uint64))
            for part, data in texts(b.filter(pa.array(ok)), 1):
                sets = [shingle_set(x, n) for x in data]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["row", "fp", "items"])

    found = hashed.mapInArrow(run, "row long, fp binary, items binary")
    return written(found.join(wanted, ["row", "fp"], "left_semi").dropDuplicates(["fp"]).select("fp", "items"), "sets")


def _verify(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """(a, b, ok) of the pairs, decided on the whole sets; a set that is not there is an error, not a pair less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if x is None or y is None:
                    raise ValueError("a candidate pair lacks a set")
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both * t.denominator >= (len(x) + len(y) - both) * t.numerator)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    x, y = (sets.select(F.col("fp").alias(c), F.col("items").alias(f"{c}_items")) for c in "ab")
    both = pairs.join(x, "a", "left").join(y, "b", "left").select("a", "b", "a_items", "b_items")
    return written(both.mapInArrow(run, "a binary, b binary, ok boolean"), "verified")


def _joined(docs: DataFrame, n: int, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, fp, n) of each row of docs, and (fp, first) of the classes that are linked or have copies: the first row of
    their component as (no_id, doc_id, row), the smallest doc_id, then the smallest hash; rows without an id last."""
    source = integer_ids(docs.select("doc_id", "text"), "doc_id").withColumn("row", F.xxhash64("text"))
    counts = written(_counted(source, n, t), "counts")
    sums = counts.agg(F.sum(F.col("c").cast("double") * F.col("c")), F.sum(F.col("c").cast("double"))).first()
    light = boundary((sums[0] or 0.0) / (sums[1] or 1.0), t)
    rows = written(_postings(source, n, t, _levels(counts), light), "postings")
    delete(source.sparkSession, counts)
    release(source.sparkSession)
    docs_of = written(rows.where("key IS NULL AND profile IS NULL").select("doc_id", "row", "fp", "n"), "docs")
    listed = _live(_split(rows.where("key IS NOT NULL").select("key", "block", "fp")), rows.where("key IS NULL AND profile IS NOT NULL"))
    delete(source.sparkSession, rows)
    release(source.sparkSession)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    classes = written(docs_of.where("fp IS NOT NULL").groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("copies")), "classes")

    members = F.collect_list(F.struct("fp", "n", "profile")).alias("members")
    lists = listed.groupBy("key", "block").agg(members)
    candidates = written(_scan(lists, t, light, labelled=False), "candidates")
    pairs = candidates.select("a", "b").distinct()
    ends = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    wanted = written(classes.join(ends, "fp", "left_semi").select("fp", "first.row"), "wanted")
    sets = _sets(source, wanted, n)
    verified = _verify(written(pairs, "pairs"), sets, t)
    links = verified.where("ok").select("a", "b")
    failed = verified.where("NOT ok").select("a", "b")
    if failed.limit(1).count():
        labels = components(links)
        again = candidates.join(failed, ["a", "b"], "left_semi").select("key", "block").distinct()
        known = labels.select(F.col("node").alias("fp"), "label")
        rest = written(listed.join(written(again, "again"), ["key", "block"], "left_semi"), "rest")
        named = rest.join(known, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        lists = named.groupBy("key", "block").agg(F.collect_list(F.struct("fp", "n", "profile", "label")).alias("members"))
        more = _scan(lists, t, light, labelled=True).select("a", "b").distinct()
        more = written(more.join(verified.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        links = links.unionByName(_verify(more, sets, t).where("ok").select("a", "b"))
    labels = components(links).select(F.col("node").alias("fp"), "label")
    # A class that is alone and has one document needs no row: its component is its own.
    named = written(classes.join(labels, "fp", "left").where("label IS NOT NULL OR copies > 1").select("fp", "first", F.coalesce("label", "fp").alias("label")), "named")
    least = named.groupBy("label").agg(F.min("first").alias("first"))
    return docs_of, written(named.select("fp", "label").join(least, "label").select("fp", "first"), "component")


def linked(docs: DataFrame, n: int = WORDS, t: Fraction = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs."""
    docs_of, component = _joined(docs, n, t)
    return docs_of.join(component, "fp", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, n: int = WORDS, t: Fraction = THRESHOLD) -> DataFrame:
    """The rows of docs but one of each component only, that with the smallest doc_id, with all their columns. A row is known by
    its doc_id and a hash of its text, so an id that is used again, or none, does not take other rows along. Of rows alike in both
    one stays; a text without words has no component and always stays."""
    docs_of, component = _joined(docs, n, t)
    met = docs_of.join(component, "fp").select("doc_id", "row", "first")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row"))
    # Each key once, and whether its rows go or all but one do; a key that stays and is not repeated needs no row.
    keys = met.groupBy("doc_id", "row").agg(F.min(stays).alias("stays"), F.count("*").alias("rows")).where("NOT stays OR rows > 1")
    keys = written(keys.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "stays"), "keys")
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), docs["doc_id"].cast("long").alias("_own_id"), F.xxhash64(docs["text"]).alias("_own_row"))
    same = F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_row") == F.col("_row"))
    kept = own.join(keys.where("NOT stays").drop("stays"), same, "left_anti")
    repeated = keys.where("stays").drop("stays")
    if repeated.limit(1).count():
        once = kept.join(repeated, same, "left_semi").groupBy("_own_id", "_own_row").agg(F.first("_doc").alias("_doc"))
        kept = kept.join(repeated, same, "left_anti").select("_doc").unionByName(once.select("_doc"))
    return kept.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(documents(spark, sf_dir), 3, Fraction(9, 10))
