"""A compressed FM-index over integer symbols: the Burrows-Wheeler transform on a wavelet matrix.

Beside the bits of the matrix, with a counter for each 64 of them, the index has a bit for each position where suffixes begin that
share depth - 1 symbols, the places of these, and the weights above 1 with theirs; neither the text nor its suffixes are kept.

Suffixes are sorted by their first ``depth`` symbols, which is enough for patterns up to that length. Searches are made for
many patterns at once, a step of all of them being one pass over the levels of the matrix.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """Bits with ranks: a counter of 32 bits, or 64 for long ones, for each 64 bits."""

    def __init__(self, bit: np.ndarray):
        n = len(bit)
        padded = np.zeros((n >> 6) * 64 + 64, dtype=np.uint8)
        padded[:n] = bit
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)
        self.ones = before.astype(np.int32) if n < 1 << 31 else before

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The ones before each position."""
        word = at >> 6
        return self.ones[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.ones.nbytes


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit of them in each level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(self.n - int(bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        every = np.arange(1 << bits)
        #: Where each symbol's occurrences begin in the last level.
        self.start = self._down(every, np.zeros_like(every))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.levels[k].rank(at)
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        return self._down(symbol, at) - self.start[symbol]


def ranks(text: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each length the order of the text's substrings of that length at each position, by doubling; short ones end in -1s."""
    n = len(text)
    known = {1: np.unique(text, return_inverse=True)[1].astype(np.int64)}

    def joined(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        second = np.zeros(n, dtype=np.int64)
        second[: max(0, n - shift)] = b[shift:] + 1
        key = a * (int(b.max(initial=0)) + 2) + second
        order = np.argsort(key)
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])[:n]
        return new

    width = 1
    while 2 * width <= max(lengths):
        known[2 * width] = joined(known[width], known[width], width)
        width *= 2
    out = {}
    for m in lengths:
        if not m:
            out[m] = np.zeros(n, dtype=np.int64)
            continue
        w = 1 << (m.bit_length() - 1)
        out[m] = known[w] if w == m else joined(known[w], known[w], m - w)  # two overlapping halves give the order
    return out


class FmIndex:
    """Over ``text`` (symbols from 0 on, 0 ends a piece), for patterns of ``depth`` symbols; weight: what a position counts."""

    def __init__(self, text: np.ndarray, depth: int, weight: np.ndarray):
        self.n, self.depth = len(text), depth
        order = ranks(text, [depth - 1, depth])
        suffixes = np.argsort(order[depth])
        bits = max(1, int(text.max(initial=0)).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))])
        self.matrix = WaveletMatrix(text[suffixes - 1], bits)  # the symbol before each suffix; the text's last before its first
        #: Where the suffixes that share depth - 1 symbols with each begin and end.
        shorter = order[depth - 1][suffixes]
        edges = np.flatnonzero(np.concatenate([[True], np.diff(shorter) != 0, [True]]))
        new = np.zeros(self.n, dtype=bool)
        new[edges[:-1]] = True
        self.groups, self.edges = Bits(new), edges.astype(np.int32 if self.n < 1 << 31 else np.int64)
        # Of weights that are all 1 the sum is the length; others are kept as the places of what is above 1, which is rare.
        extra = weight[suffixes] - 1
        self.heavy = np.flatnonzero(extra)
        self.extra = np.concatenate([[0], np.cumsum(extra[self.heavy])])

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (*self.matrix.levels, self.groups, self.edges, self.heavy, self.extra, self.first, self.matrix.start))

    def _widened(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the suffixes that share depth - 1 symbols with those of non-empty intervals."""
        return self.edges[self.groups.rank(low + 1) - 1].astype(np.int64), self.edges[self.groups.rank(high)].astype(np.int64)

    def _weight(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(self.heavy, low), np.searchsorted(self.heavy, high)
        return np.maximum(high - low, 0) + self.extra[np.maximum(a, b)] - self.extra[a]

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with a symbol put before them."""
        half = len(low)
        at = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.first[symbol] + at[:half], self.first[symbol] + at[half:]

    def matching(self, pieces: list[np.ndarray]) -> list[np.ndarray]:
        """For each piece, what its windows of ``depth`` symbols weigh in the text: matching statistics at that length.

        A piece is read backwards: after depth symbols each further one first drops the window's last symbol, which widens the
        interval to the suffixes with depth - 1 symbols in common, and then extends it."""
        lengths = np.array([len(p) for p in pieces])
        out = [np.zeros(max(0, n - self.depth + 1), dtype=np.int64) for n in lengths.tolist()]
        flat, ends = np.concatenate([np.empty(0, np.int64), *pieces]), np.cumsum(lengths)
        low, high = np.zeros(len(pieces), dtype=np.int64), np.full(len(pieces), self.n, dtype=np.int64)
        weights = np.zeros(len(flat), dtype=np.int64)
        alive = np.flatnonzero(lengths >= self.depth)
        for step in range(int(lengths.max(initial=0))):
            alive = alive[lengths[alive] > step]
            if not len(alive):
                break
            a, b = low[alive], high[alive]
            if step >= self.depth:
                some = b > a
                a[some], b[some] = self._widened(a[some], b[some])
            at = ends[alive] - 1 - step
            a, b = self.extend(a, b, flat[at])
            low[alive], high[alive] = a, b
            if step >= self.depth - 1:
                weights[at] = self._weight(a, b)
        for k in range(len(pieces)):
            start = ends[k] - lengths[k]
            out[k] = weights[start : start + len(out[k])]
        return out
