"""Token files: canonical length-limited Huffman coding of token ids.

Documents are encoded, ended by an end id, and put in ascending doc_id order into shards by doc_id range. The ids of all
documents are counted; package-merge gives code lengths of at most MAX_BITS, and codes are canonical (by length, then
id), so the table of lengths is all that a reader needs. A file's rows are independent blocks of whole documents:
the bits, the documents' ids and lengths, and the bit offset of every STEP-th id. A reader decodes the stretches between
these checkpoints side by side through one lookup table. Files are written by Spark's committing writer, so a lost
executor leaves no half-written block, in the layout

    <folder>/blocks    one row for each block        <folder>/lengths   (id, bits)
    <folder>/manifest  (block_id, start): ids before the block in the whole order

Null and odd input: a null or empty text has the end id only; a null doc_id comes first; rows of equal doc_id follow in the
order of a hash of their ids; an empty table gives empty files. Only doc_id and text are read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.llm.bpe import parts, tokenizer_path, vocabulary_text
from engram.llm.common import claim, delete, documents, integer_ids, shared_dir, shuffle_partitions, written
from engram.llm.units import BLANK_WORD, WORD, Cutter, Memory, binaries, by_parts, data_of, joined, kinds, offsets, pieces

MAX_BITS = 20
STEP = 128
#: A block takes documents up to this many ids, or one longer document.
BLOCK_IDS = 1 << 17
PIECE = 1 << 15
#: Units, and parts of units, remembered in a worker.
KNOWN, KNOWN_PARTS = 200_000, 500_000


class LibraryEncoder:
    """The tokenizers library, asked once for each unit, or word and marks of a unit, while that is remembered.

    Parts not remembered are joined to texts in which each stays on its own, encoded in one call, and the ids are dealt out by
    their byte lengths. A text with a special token is one unit.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        n = self.tokenizer.get_vocab_size()
        added = self.tokenizer.get_added_tokens_decoder()
        self.sizes = np.array([len(added[i].content.encode() if i in added else self.tokenizer.id_to_token(i)) for i in range(n)])
        self.type = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.special = [t.content for t in added.values()]
        self.cutter = _WholeIfSpecial(self.special)
        self.parts = Memory(self._learn, KNOWN_PARTS)
        self.units = Memory(lambda units: by_parts(units, self.parts.values), KNOWN)

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _learn(self, found: pa.Array) -> pa.Array:
        """The ids of distinct parts: those after a blank in one row, those without blanks at their ends with line ends between
        them, others alone."""
        kind = kinds(found)
        for t in self.special:
            kind[pc.match_substring(found, t).to_numpy(zero_copy_only=False)] = 0
        after, bare, rest = (np.flatnonzero(k) for k in (kind == BLANK_WORD, kind == WORD, (kind != BLANK_WORD) & (kind != WORD)))
        ended = pc.binary_join_element_wise(found.take(pa.array(bare)), *(pa.scalar(x, pa.large_string()) for x in ("\n", "")))
        alone = pa.array([self._alone(p) for p in found.take(pa.array(rest)).to_pylist()], pa.large_binary())
        made = pa.concat_arrays([self._dealt(found.take(pa.array(after)), 0), self._dealt(ended, 1), alone])
        return made.take(pa.array(np.argsort(np.concatenate([after, bare, rest]))))

    def _dealt(self, found: pa.Array, drop: int) -> pa.Array:
        """The ids of parts that stay on their own when joined, but for the last ``drop`` of each."""
        if not len(found):
            return pa.array([], pa.large_binary())
        ends, data = offsets(found)[1:], data_of(found)
        cuts = [0, *ends[np.unique(np.searchsorted(ends, np.arange(PIECE, ends[-1], PIECE)))].tolist(), int(ends[-1])]
        texts = [str(data[a:b], "utf-8") for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        flat = np.concatenate([np.array(e.ids, self.type) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        reached = np.cumsum(self.sizes[flat])
        stops = np.searchsorted(reached, ends) + 1
        if not (reached[stops - 1] == ends).all():
            raise ValueError("a token crosses the end of a part")
        if drop:
            last = np.zeros(len(flat), dtype=bool)
            last[stops - 1] = True
            flat, stops = flat[~last], stops - np.arange(1, len(stops) + 1)
        return binaries(np.concatenate([[0], stops]) * self.type.itemsize, flat.tobytes())

    def encode(self, texts: list[str | None], end: bytes = b"") -> list[bytes]:
        """The ids of each text, as integers of self.type, and ``end`` after them."""
        out: list[bytes] = []
        begun: list[bytes] = []
        for held, last in pieces(texts):
            distinct, codes, ends = self.cutter.batch(held)
            data, at = joined(self.units.values(distinct), codes, ends)
            start = 0
            for stop, done in zip(at.tolist(), last, strict=True):
                begun.append(data[start:stop].to_pybytes())
                start = stop
                if done:
                    out.append(b"".join([*begun, end]))
                    begun = []
        return out


class _WholeIfSpecial(Cutter):
    def by_pattern(self, text: str) -> list[str]:
        return [text] if any(t in text for t in self.special) else super().by_pattern(text)


_encoder: dict[int, LibraryEncoder] = {}


def _library(vocabulary: str) -> LibraryEncoder:
    claim("token_files", _encoder.clear)
    key = hash(vocabulary)
    if key not in _encoder:
        _encoder.clear()
        _encoder[key] = LibraryEncoder(vocabulary)
    return _encoder[key]


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths up to ``limit`` by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels = []
    packages = np.empty(0)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(leaves))
        sums = both[rank]
        packages = sums[0 : len(sums) // 2 * 2 : 2] + sums[1::2]
    take = 2 * len(leaves) - 2
    for leaf in levels[::-1]:
        n = int(leaf[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    codes = np.zeros(len(lengths), dtype=np.int64)
    code = last = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        if n := int(lengths[i]):
            code <<= n - last
            codes[i], code, last = code, code + 1, n
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    """(bits, bit offset of every STEP-th id, how many bits)."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros((total >> 5) + 2, dtype=np.uint64)
    if total:
        word = starts >> 5
        shifted = codes[ids].astype(np.uint64) << (64 - (starts & 31) - n).astype(np.uint64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        words[word[first]] += np.add.reduceat(shifted >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes(), starts[::STEP].astype("<u4"), total


class Decoder:
    def __init__(self, lengths: np.ndarray):
        codes, self.bits = canonical_codes(lengths), max(int(lengths.max(initial=1)), 1)
        self.ids, self.used = np.zeros(1 << self.bits, dtype=np.int32), np.ones(1 << self.bits, dtype=np.uint8)
        for i in np.flatnonzero(lengths).tolist():
            a, b = int(codes[i]) << (self.bits - int(lengths[i])), (int(codes[i]) + 1) << (self.bits - int(lengths[i]))
            self.ids[a:b], self.used[a:b] = i, lengths[i]

    def unpack(self, bits: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """All n ids of a block: the stretches from each checkpoint to the next are decoded side by side."""
        w = np.concatenate([np.frombuffer(bits, ">u4").astype(np.uint64), np.zeros(2, np.uint64)])
        double = w[:-1] << np.uint64(32) | w[1:]
        at, out, keep = checkpoints.astype(np.int64), np.empty((STEP, len(checkpoints)), dtype=np.int32), np.uint64(64 - self.bits)
        last = len(double) - 1
        for k in range(STEP):
            seen = (double[np.minimum(at >> 5, last)] << (at & 31).astype(np.uint64)) >> keep
            out[k] = self.ids[seen]
            at = at + self.used[seen]
        return out.T.ravel()[:n]


_BLOCKS = "block_id string, shard int, doc_ids array<long>, lengths array<int>, checkpoints binary, bits binary, bits_crc long"


def _packer(lengths: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, task = canonical_codes(lengths), TaskContext.get()
        kind = np.dtype(f"<u{width}")
        schema = pa.schema([("block_id", pa.string()), ("shard", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("checkpoints", pa.binary()), ("bits", pa.binary()), ("bits_crc", pa.int64())])
        made = 0

        def block(rows: list) -> pa.RecordBatch:
            nonlocal made
            ids = np.frombuffer(b"".join(r[2] for r in rows), kind)
            bits, checkpoints, _ = pack(ids, codes, lengths)
            made += 1
            row = {"block_id": f"{task.partitionId():06d}-{made:06d}", "shard": rows[0][0], "doc_ids": [r[1] for r in rows], "lengths": [len(r[2]) // width for r in rows], "checkpoints": checkpoints.tobytes(), "bits": bits, "bits_crc": zlib.crc32(bits)}
            return pa.RecordBatch.from_pylist([row], schema)

        rows, held = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = len(row[2]) // width
                if rows and (held + n > BLOCK_IDS or rows[0][0] != row[0]):
                    yield block(rows)
                    rows, held = [], 0
                rows.append(row)
                held += n
        if rows:
            yield block(rows)

    return run


def _ids(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(shard, doc_id, ids as little-endian integers): shards are doc_id ranges, sorted within."""
    spark = docs.sparkSession
    source = integer_ids(docs.select("doc_id", "text"), "doc_id")
    n = shuffle_partitions(spark)
    bounds = source.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 100_000)).first()[0] or []
    above = np.array(sorted(set(bounds)), dtype=np.int64)
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _library(shared.value)
        end = np.array([end_id], encoder.type).tobytes()
        for b in batches:
            for rows in parts(b, 2048):
                known = rows.column(0).is_valid().to_numpy(zero_copy_only=False)
                shard = np.where(known, np.searchsorted(above, rows.column(0).fill_null(0).to_numpy()), 0).astype(np.int32)
                ids = encoder.encode(rows.column(1).to_pylist(), end)
                yield pa.RecordBatch.from_arrays([pa.array(shard), rows.column(0), pa.array(ids, pa.binary())], ["shard", "doc_id", "ids"])

    ids = source.mapInArrow(run, "shard int, doc_id long, ids binary").repartitionById(n, "shard")
    return written(ids.sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")), "ids")


def _counts(ids: DataFrame, size: int, width: int) -> np.ndarray:
    """How often each id occurs in all documents; at most one number for each id of the vocabulary comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.int64)
        for b in batches:
            for rows in parts(b):  # the values of a slice lie next to one another
                counts += np.bincount(np.frombuffer(b"".join(rows.column(0).to_pylist()), f"<u{width}"), minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["id", "n"])

    out = np.zeros(size, dtype=np.int64)
    for r in ids.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["id"]] = r["n"]
    return out


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0) -> None:
    """Encode the texts with the tokenizers library and write them, in ascending doc_id order, under folder."""
    spark = docs.sparkSession
    ids = _ids(docs, vocabulary, end_id)
    encoder = _library(vocabulary)
    size, width = max(encoder.tokenizer.get_vocab_size(), end_id + 1), encoder.type.itemsize
    lengths = code_lengths(_counts(ids, size, width))
    spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths) if n] or [(end_id, 1)], "id int, bits int").coalesce(1).write.parquet(f"{folder}/lengths")
    ids.select("shard", "doc_id", "ids").mapInArrow(_packer(lengths, width), _BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    delete(spark, ids)
    blocks = spark.read.parquet(f"{folder}/blocks").select(
        "block_id", "shard", F.array_min("doc_ids").alias("low"), F.array_max("doc_ids").alias("high"), "bits_crc", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")
    )
    # Blocks of a shard, then shards: both are few, and no ordering takes all blocks to one task.
    within = W.partitionBy("shard").orderBy(F.col("low").asc_nulls_first(), F.col("high").asc_nulls_first(), "bits_crc", "block_id").rowsBetween(W.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("shard_n"))
    base = shards.select("shard", F.coalesce(F.sum("shard_n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    starts = blocks.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(base, "shard")
    starts.select("block_id", (F.col("base") + F.col("before")).alias("start")).write.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str, crc_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>) of each document, decoded from the files; crc_only: ids_crc32 instead of ids."""
    size = [(r["id"], r["bits"]) for r in spark.read.parquet(f"{folder}/lengths").collect()]  # bounded by the vocabulary
    lengths = np.zeros(max(i for i, _ in size) + 1, dtype=np.uint8)
    for i, n in size:
        lengths[i] = n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for b in batches:
            for row in b.to_pylist():
                n = sum(row["lengths"])
                if zlib.crc32(row["bits"]) != row["bits_crc"]:
                    raise ValueError(f"block {row['block_id']} is damaged")
                ids = decoder.unpack(row["bits"], np.frombuffer(row["checkpoints"], "<u4"), n)
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                if crc_only:
                    last = pa.array([zlib.crc32(ids[a:z].astype("<u4").tobytes()) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array([row["block_id"]] * len(ends)), pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["lengths"], pa.int64()), last], ["block_id", "doc_id", "offset", "n_tokens", "last"])

    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    docs = blocks.mapInArrow(run, f"block_id string, doc_id long, offset long, n_tokens long, last {'long' if crc_only else 'array<int>'}")
    manifest = spark.read.schema("block_id string, start long").parquet(f"{folder}/manifest")
    return docs.join(manifest, "block_id").select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", F.col("last").alias("ids_crc32" if crc_only else "ids"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/engram/tokens-{uuid.uuid4().hex}"
    write_token_files(documents(spark, sf_dir), folder, vocabulary_text(tokenizer_path()))
    return read_token_files(spark, folder, crc_only=True)
