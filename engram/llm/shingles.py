"""Hashes of words and word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from engram.llm.common import claim

REMEMBERED = 150_000


class WordHashes(dict):
    """Word (bytes) -> its 8-byte hash; the memory is bounded."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[word] = xxhash.xxh3_64_digest(word)
        return out


_words = WordHashes()


def word_hashes(data: bytes, lower: bool = False) -> np.ndarray:
    """The hashes of the words of a UTF-8 text (bytes.split and bytes.lower know ASCII only, as wanted)."""
    return hashes_of((data.lower() if lower else data).split())


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([_words[w] for w in words]), dtype="<u8")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def rolled(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, in time linear in the words: wrap-around polynomial, then scrambled."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    base = np.uint64(0xD6E8FEB86659FD93)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    # By doubling: hashes of 2^k words from those of 2^(k-1); the bits of n say which to append.
    power, width, block = base, 1, mixed(words)
    done = 0
    while True:
        if n & width:
            out = out * power + block[done : done + len(out)]
            done += width
        if done == n:
            return mixed(out)
        block = block[: len(block) - width] * power + block[width:]
        power = np.uint64(int(power) ** 2 % (1 << 64))
        width *= 2


def shingle_set(data: bytes | None, n: int) -> np.ndarray:
    """The sorted distinct n-word shingles of a text, ASCII letters lower-cased; with fewer words the whole sequence as one."""
    words = word_hashes(data, lower=True) if data else np.empty(0, dtype=np.uint64)
    if len(words) >= n:
        return np.unique(rolled(words, n))
    if not len(words):
        return words
    return np.array([xxhash.xxh3_64_intdigest(words.tobytes(), seed=len(words))], dtype=np.uint64)


def texts(batch: pa.RecordBatch, column: int, rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of a batch and their texts as UTF-8."""
    claim("words", _words.clear)
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part, part.column(column).cast(pa.binary()).to_pylist()
