import hashlib
import random

import numpy as np
import pytest

from engram.llm import periodic
from engram.llm.common import words_of

from .helpers import awkward, corpus, frame


def brute(words):
    """Every stretch by every period, from the words alone."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(12, 2 * q):
                found.setdefault((start, i + q - start), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def digests(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    shas = ["".join(f"{s},{n},{q}\n" for s, n, q in found), " ".join(w for i, w in enumerate(words) if i not in gone)]
    return [hashlib.sha256(x.encode()).hexdigest() for x in shas]


def made(rng):
    """Words of few kinds, with planted repeats within repeats."""
    words = [rng.choice("abcde") for _ in range(rng.randint(0, 40))]
    for _ in range(rng.randint(1, 4)):
        period = [rng.choice("abc") for _ in range(rng.randint(1, 20))]
        words += (period * 12)[: rng.randint(1, 90)]
        words += [rng.choice("abcdefghij") for _ in range(rng.randint(0, 15))]
    return words if rng.random() < 0.5 else words * rng.randint(1, 3)


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        words = made(rng)
        number = {}
        codes = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
        assert periodic.runs(codes) == brute(words)


def test_heavy_words_are_counted_by_transform(monkeypatch):
    rng = random.Random(4)
    for heavy in (0, periodic.HEAVY):
        monkeypatch.setattr(periodic, "HEAVY", heavy)
        for _ in range(60):
            words = made(rng)
            codes = np.array([ord(w) for w in words], dtype=np.int64)
            got = periodic.matches(codes, np.arange(len(codes)))
            assert got[1:].tolist() == [sum(a == b for a, b in zip(words, words[q:])) for q in range(1, len(words) // 2 + 1)]


def test_long_constant_text_is_one_run():
    assert periodic.runs(np.zeros(200_000, dtype=np.int64)) == [(0, 200_000, 1)]
    line = np.tile(np.arange(10), 10_000)
    assert periodic.runs(line) == [(0, 100_000, 10)]


@pytest.mark.parametrize("vary", [False, True])
def test_documents_equal_brute_force(spark, vary):
    rng, rows = random.Random(5), corpus(6, 40)
    rows += [(1000 + i, " ".join(made(rng)), "en", "s1") for i in range(60)] + [(2000, "same " * 3000, "en", "s1"), (2001, "a b\vc d e " * 9, None, None)]
    rows = [r for r in awkward(rows) if not r[1] or len(r[1]) < 60_000]
    want = []
    for i, text, *_ in rows:
        words = words_of(text)
        if vary:
            words = [w.decode() for w in periodic.varied([w.encode() for w in words], i)]
        found = brute(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        want.append((i, len(found), *best, 1000 * best[1] // best[2] if found else None, *digests(words, found)))
    got = [tuple(r)[:8] for r in periodic.detect(frame(spark, rows), vary).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert any(w[1] for w in want)


def test_tail_of_the_varied_text():
    words = [b"%d" % i for i in range(100)]
    changed = 0
    for doc in range(200):
        out = periodic.varied(words, doc)
        assert len(out) == 100
        if out != words:
            changed += 1
            g = __import__("zlib").crc32(str(doc).encode()) // 10
            a = g % 100
            p = 1 + (100 - a) // (3 + g % 8)
            assert out == [words[i] if i < a else words[a + (i - a) % p] for i in range(100)]
    assert changed


def test_empty_table(spark):
    assert periodic.detect(frame(spark, [])).collect() == []
