"""Byte-level BPE by per-prefix dynamic programming.

Every prefix of a pre-token has one encoding and so one last token. A token t that ends at position i is that last
token exactly if the prefix before t ends in a token p such that p and t stay apart when their bytes are merged
together (pair compatibility). The tokens that end at each position come from an automaton over all token strings that
yields every suffix match; the last token of each prefix is stored, and following the tokens' lengths back from the end
emits the ids. The cost is linear in the text, however long a pre-token is. No merge loop runs over the text.

Two tokens stay apart unless, at some time of the merging, the piece left of their border and the piece right of it
form a pair whose merge comes before either piece is consumed: the pieces are walked back from the whole tokens, undoing
the later merge first (of equal ranks the right one, as merging goes from left to right).

Texts are cut into units between pre-tokens (units), so what is encoded once can be looked up again: the memories of units and
of pre-tokens are bounded and hold short ones only. Ids become decimal digits and bytes by Arrow lookups in the vocabulary, a
batch at a time.

Null and odd input: a null text counts as empty and has no tokens; special tokens in a text are matched as the library
does; null doc_ids, repeated rows and an empty table go through row by row; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from engram.llm.common import claim, documents, give_back, integer_ids
from engram.llm.units import Cutter, Memory, by_parts, data_of, joined, offsets, pieces

TOKENIZER = "byte_bpe_50k.json"
#: Fixed value: the pattern of pre-tokens of this family of vocabularies.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Units, and parts of units, remembered in a worker.
KNOWN, KNOWN_PARTS = 60_000, 150_000
#: Pairs of tokens whose compatibility is remembered.
KNOWN_PAIRS = 100_000
#: Characters of texts that are in work at once.
AT_ONCE = 1 << 19
#: Parts that are one pre-token: a word, or marks.
WHOLE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+")
NEVER = 1 << 60


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Bpe:
    """A byte-level BPE vocabulary read from the text of a tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.bytes: dict[int, bytes] = {i: bytes(letters[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.rank = dict.fromkeys(self.bytes, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            self.merge.setdefault(pair, k)
            if made not in self.parts:
                self.parts[made], self.rank[made] = pair, k
        self.automaton = ahocorasick.Automaton()
        for i in vocab.values():
            # A token whose own parts would not find together is never emitted.
            if i not in self.parts or self._apart(*self.parts[i], self.rank[i]):
                s = self.bytes[i].decode("latin-1")
                self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self._pairs: dict[tuple[int, int], bool] = {}
        self.cutter = Cutter(list(self.special))
        self.parts_known = Memory(self.encode_parts, KNOWN_PARTS)
        self.units_known = Memory(lambda units: by_parts(units, self.parts_known.values), KNOWN)
        top = max(self.bytes) + 1
        self.digits = pa.array([f",{i}" for i in range(top)], pa.large_binary())
        self.raw = pa.array([self.bytes.get(i) for i in range(top)], pa.large_binary())

    def _apart(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether a and b stay apart, by merges of a rank below ``before``."""
        end_a = end_b = before
        merge, rank, parts = self.merge, self.rank, self.parts
        while True:
            m = merge.get((a, b), NEVER)
            if m < end_a and m <= end_b and m < before:
                return False
            if rank[a] > rank[b]:
                end_a, a = rank[a], parts[a][1]
            elif rank[b] >= 0:
                end_b, b = rank[b], parts[b][0]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        found = self._pairs.get((a, b))
        if found is None:
            if len(self._pairs) >= KNOWN_PAIRS:
                self._pairs.clear()
            found = self._pairs[a, b] = self._apart(a, b)
        return found

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        """The ids of one pre-token's bytes."""
        last, size = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        pairs, compatible = self._pairs, self.compatible
        for at, (token, n) in self.automaton.iter(data.decode("latin-1")):
            end = at + 1
            if last[end] < 0:
                if n == end:
                    fits = True
                else:
                    before = last[end - n]
                    fits = pairs.get((before, token))
                    if fits is None:
                        fits = compatible(before, token)
                if fits:
                    last[end], size[end] = token, n
        out, end = [], len(data)
        while end:
            out.append(last[end])
            end -= size[end]
        return tuple(out[::-1])

    def encode_parts(self, parts: pa.Array) -> pa.Array:
        """The ids, as 32-bit integers, of stretches of text that begin and end between pre-tokens; a special token is one."""
        out, encode, whole, special = [], self.encode_piece, WHOLE.fullmatch, self.special
        for part in parts.to_numpy(zero_copy_only=False).tolist():
            if whole(part):
                ids = encode(part.encode())
            elif part in special:
                ids = (special[part],)
            else:
                ids = [i for p in PRETOKEN.findall(part) for i in encode(p.encode())]
            out.append(array("i", ids).tobytes())
        return pa.array(out, pa.large_binary())

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts, and where each text's end."""
        distinct, codes, ends = self.cutter.batch(texts)
        data, at = joined(self.units_known.values(distinct), codes, ends)
        return np.frombuffer(data, "<i4", count=int(at[-1]) // 4 if len(at) else 0), at // 4

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def loaded(text: str) -> Bpe:
    """One vocabulary for each Python worker."""
    claim("bpe", _loaded.clear)
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(text)
    return _loaded[key]


def looked_up(table: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """(data, at): the table's entries of the ids one after another, and where each begins, with the end of all."""
    got = table.take(pa.array(ids))
    return memoryview(data_of(got)), offsets(got)


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids): the token ids of each text. vocabulary: the text of the tokenizer file (bounded, broadcast)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared.value)
        for b in batches:
            flat, ends, total = [np.empty(0, "<i4")], [0], 0
            for texts, last in pieces(b.column(1).to_pylist(), AT_ONCE):
                ids, at = bpe.encode_batch(texts)
                flat.append(ids)
                ends += (total + at[np.array(last)]).tolist()
                total += len(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))], ["doc_id", "ids"])

    return integer_ids(docs.select("doc_id", "text"), "doc_id").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared.value)
        for b in batches:
            texts = [bpe.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def parts(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _digested(batches: Iterator[pa.RecordBatch], bpe: Bpe) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> digests of the ids and of the decoded text. An idle worker keeps no more than ``bpe`` remembers."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for b in batches:
        counts, ids_sha, text_sha = [], [], []
        n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
        for texts, last in pieces(b.column(1).to_pylist(), AT_ONCE):
            ids, ends = bpe.encode_batch(texts)
            digits, digits_at = looked_up(bpe.digits, ids)
            raw, raw_at = looked_up(bpe.raw, ids)
            start = 0
            for end, done in zip(ends.tolist(), last, strict=True):
                comma = not n and end > start  # each id's digits follow a comma, but for a text's first
                ids_hash.update(digits[digits_at[start] + comma : digits_at[end]])
                text_hash.update(str(raw[raw_at[start] : raw_at[end]], "utf-8", "replace").encode())
                n, start = n + end - start, end
                if done:
                    counts.append(n)
                    ids_sha.append(ids_hash.hexdigest())
                    text_sha.append(text_hash.hexdigest())
                    n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
            del ids, digits, raw
            give_back(collect=False)  # else Arrow's pool keeps several times what is in work
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names)
        del b  # not held while the next one is read
    give_back()


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, document by document."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _digested(batches, loaded(shared.value))

    return integer_ids(docs.select("doc_id", "text"), "doc_id").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary_text(path: str | None = None) -> str:
    with open(path or tokenizer_path(), encoding="utf-8") as f:
        return f.read()


def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), vocabulary_text())
