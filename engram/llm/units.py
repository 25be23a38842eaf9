"""Texts as units that begin and end between pre-tokens, each distinct unit of a batch once.

Pre-tokens of byte-level vocabularies always end before a blank that a non-blank follows, and on both sides of a line's end
between two non-blanks. Cutting, telling distinct units apart and putting values back in their order are Arrow kernels over
the whole batch; Python sees only the distinct units. Texts with other runs of white space, with a special token or with
the mark that is used for cutting are cut by patterns instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stands between units while a batch is cut; a text that holds it is cut by patterns.
MARK = "\x1e"
#: A blank followed by a blank, where cutting at single blanks needs care.
DOUBLE = re.compile(r" (?=\s)| \Z")
CUT = re.compile(r"(?= \S)")
#: Characters of a text that are in work at once.
STRETCH = 1 << 22
#: Units longer than this are not remembered.
LONGEST = 48


def units(text: str) -> list[str]:
    """text cut before each blank that a non-blank follows."""
    if not text:
        return []
    if DOUBLE.search(text):
        return CUT.split(text)
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + x for x in rest]


def stretches(text: str, most: int = STRETCH) -> Iterator[str]:
    """text in stretches of about ``most`` characters, or longer ones where there is no place to cut."""
    at = 0
    while len(text) - at > most and (m := CUT.search(text, at + most)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def pieces(texts: list[str | None], most: int = STRETCH) -> Iterator[tuple[list[str], list[bool]]]:
    """Consecutive texts of about ``most`` characters together, and whether each ends its text; a longer text comes in stretches."""
    held, last, size = [], [], 0
    for text in texts:
        text = text or ""
        for s in stretches(text, most) if len(text) > most else (text,):
            if held and size + len(s) > most:
                yield held, last
                held, last, size = [], [], 0
            held.append(s)
            last.append(False)
            size += len(s)
        last[-1] = True
    if held:
        yield held, last


class Cutter:
    """Cuts batches of texts; special: strings that are tokens of their own wherever they stand."""

    def __init__(self, special: list[str]):
        self.special = set(special)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.alone = "|".join(map(re.escape, [MARK, *special]))

    def by_pattern(self, text: str) -> list[str]:
        """The units of any text; a special token is a unit."""
        parts = self.split(text) if self.split else [text]
        return [u for p in parts for u in ([p] if p in self.special else units(p))]

    def batch(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(distinct units, codes, ends): text i has the units of codes[ends[i - 1]:ends[i]]."""
        whole = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(whole, self.alone).to_numpy(zero_copy_only=False)
        marked = pc.replace_substring(pc.replace_substring(whole, " ", MARK + " "), "\n", f"{MARK}\n{MARK}")
        cut = pc.split_pattern(marked, MARK)
        ends = cut.offsets.to_numpy()[1:].astype(np.int64)
        coded = cut.values.dictionary_encode()
        distinct, codes = coded.dictionary, coded.indices.to_numpy()
        kind = kinds(distinct)[codes]
        doc = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        odd[doc[kind == ODD]] = True
        kept = np.flatnonzero(kind != EMPTY)
        codes, kind, doc = codes[kept], kind[kept], doc[kept]
        # Of two line ends in a row the first is a pre-token of its own only if a non-blank follows the second.
        line, after = kind == LINE, np.concatenate([np.where(doc[1:] == doc[:-1], kind[1:], EMPTY), [EMPTY]]) if len(doc) else kind
        pair = np.flatnonzero(line[:-1] & (after[:-1] == LINE) & (after[1:] != WORD))
        odd[doc[pair]] = True
        counts = np.bincount(doc, minlength=len(texts))
        if not odd.any():
            return distinct, codes, np.cumsum(counts)
        known = {u: k for k, u in enumerate(_listed(distinct))}
        own = {}
        for d in np.flatnonzero(odd).tolist():
            own[d] = [known.setdefault(u, len(known)) for u in self.by_pattern(texts[d])]
            counts[d] = len(own[d])
        ends, regular = np.cumsum(counts), ~odd[doc]
        out = np.empty(int(ends[-1]), dtype=np.int64)
        out[np.repeat(~odd, counts)] = codes[regular]
        for d, found in own.items():
            out[ends[d] - len(found) : ends[d]] = found
        return pa.array(list(known), pa.large_string()), out, ends


EMPTY, WORD, BLANK_WORD, LINE, ODD = range(5)
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def kinds(distinct: pa.Array) -> np.ndarray:
    """Of each piece: nothing, a word, one after a blank, a line's end, or one with other white space at an end."""

    def where(found: pa.Array) -> np.ndarray:
        return found.to_numpy(zero_copy_only=False)

    after = where(pc.starts_with(distinct, " "))
    kind = np.where(after, BLANK_WORD, WORD).astype(np.int8)
    kind[where(pc.match_substring_regex(distinct, f"^ (?:{_BLANK}|$)|{_BLANK}$")) | (~after & where(pc.match_substring_regex(distinct, f"^{_BLANK}")))] = ODD
    kind[where(pc.equal(distinct, "\n"))] = LINE
    kind[where(pc.equal(distinct, ""))] = EMPTY
    return kind


def _listed(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


def offsets(values: pa.Array) -> np.ndarray:
    """Where each value of a large string or binary array begins in its data, with the end of the last."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, 8 * values.offset)


def data_of(values: pa.Array) -> pa.Buffer:
    return values.buffers()[2] or pa.py_buffer(b"")


def binaries(ends: np.ndarray, data: bytes | pa.Buffer, kind: pa.DataType | None = None) -> pa.Array:
    """The array whose values lie one after another in data; ends: from 0 to the end of the last."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(data)]
    return pa.Array.from_buffers(kind or pa.large_binary(), len(ends) - 1, buffers)


class Memory:
    """What ``make`` gives for strings, remembered for short ones: the ``most`` that were met last, by batches."""

    def __init__(self, make: Callable[[pa.Array], pa.Array], most: int):
        self.make, self.most = make, most
        self.keys, self.known = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def values(self, distinct: pa.Array) -> pa.Array:
        """The values of distinct strings."""
        found = pc.index_in(distinct, value_set=self.keys)
        new = found.is_null()
        made = self.make(distinct.filter(new))
        at = found.to_numpy(zero_copy_only=False).astype(np.float64)
        missing = new.to_numpy(zero_copy_only=False)
        at[missing] = len(self.keys) + np.arange(int(missing.sum()))
        at = at.astype(np.int64)
        values = pa.concat_arrays([self.known, made]).take(pa.array(at))
        met = np.ones(len(self.keys), dtype=bool)
        met[at[~missing]] = False
        short, rest = pc.less_equal(pc.binary_length(distinct), LONGEST), pa.array(met)
        self.keys = pa.concat_arrays([distinct.filter(short), self.keys.filter(rest)])
        self.known = pa.concat_arrays([values.filter(short), self.known.filter(rest)])
        if len(self.keys) > self.most:  # taken, not sliced: a slice would hold all
            kept = pa.array(np.arange(self.most))
            self.keys, self.known = self.keys.take(kept), self.known.take(kept)
        return values


def joined(values: pa.Array, codes: np.ndarray, ends: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
    """(data, ends): the values of the codes one after another, and where each text's part of them ends."""
    got = values.take(pa.array(codes))
    return data_of(got), offsets(got)[ends]


#: A word and marks after it are two pre-tokens; letters and marks whose kind no version of Unicode changes.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_MARKED = f"^ ?[{_LETTERS}]+[{re.escape(_MARKS)}]+$"


def by_parts(units: pa.Array, values: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """The values of units as those of their parts, a word and the marks after it, one after another; any other unit is one part.
    values: distinct strings -> values."""
    if not len(units):
        return pa.array([], pa.large_binary())
    starts = offsets(units)
    marked = np.flatnonzero(pc.match_substring_regex(units, _MARKED).to_numpy(zero_copy_only=False))
    words = pc.binary_length(pc.utf8_rtrim(units.take(pa.array(marked)), _MARKS)).to_numpy()
    cuts = np.insert(starts, marked + 1, starts[marked] + words)
    coded = binaries(cuts, data_of(units), pa.large_string()).dictionary_encode()
    got = values(coded.dictionary).take(coded.indices)
    unit_ends = np.arange(len(units) + 1) + np.searchsorted(marked, np.arange(len(units) + 1))
    return binaries(offsets(got)[unit_ends], data_of(got))
