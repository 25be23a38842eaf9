import hashlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from engram.llm import fm_index
from engram.llm import jaccard_join as J
from engram.llm import substring_dedup as S
from engram.llm.components import components
from engram.llm.shingles import rolled

from .helpers import awkward, corpus, frame


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_links(rows, n, t):
    sets = [shingles(x, n) for _, x, *_ in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * t.denominator >= (len(sets[i]) + len(sets[j]) - both) * t.numerator:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[label[k]] = min(least.get(label[k], i), i)
    return Counter((i, len(sets[k]), least.get(label[k]) if sets[k] else i) for k, (i, *_) in enumerate(rows))


@pytest.mark.parametrize(("n", "t"), [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (1, Fraction(1, 2))])
def test_links(spark, n, t):
    rows = awkward(corpus(3, 80))
    got = J.linked(frame(spark, rows), n, t)
    assert Counter(tuple(r) for r in got.collect()) == brute_links(rows, n, t)


def test_small_blocks_light_only_and_heavy_only(spark, monkeypatch):
    rows = corpus(5, 60)
    expected = brute_links(rows, 3, Fraction(7, 10))
    for name, value in (("BLOCK", 2), ("SCAN", 0.0), ("SCAN", 1e6)):
        # (Workers see the module's own constants; these reach the driver's side: the boundary.)
        monkeypatch.setattr(J, name, value)
        assert Counter(tuple(r) for r in J.linked(frame(spark, rows), 3, Fraction(7, 10)).collect()) == expected


def test_blocks_cover_every_pair():
    fps = [bytes([i, 0, 0, 0]) for i in range(40)]
    level = 1 + int(4 * np.log2(5 * J.BLOCK))
    places = [set(J._blocks(f, level + 2)) for f in fps]
    assert len(places[0]) > 1 and all(a & b for a in places for b in places)


def test_profiles_never_rule_out_a_pair():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 2**63, 60).astype(np.uint64)
        b = np.concatenate([a[: rng.integers(30, 60)], rng.integers(0, 2**63, rng.integers(0, 20)).astype(np.uint64)])
        p = [np.packbits(np.bincount((x % np.uint64(8 * J.PROFILE)).astype(int), minlength=8 * J.PROFILE) & 1).view("<u8") for x in (np.unique(a), np.unique(b))]
        assert np.bitwise_count(p[0] ^ p[1]).sum() <= len(np.setxor1d(a, b))


def test_one_of_each(spark):
    rows = corpus()
    docs = frame(spark, rows)
    got = J.one_of_each(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == {c for _, _, c in brute_links(rows, 5, Fraction(4, 5))}
    assert J.one_of_each(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(i, 100) for i in range(60, 90)] + [(200, 201), (201, 200), (5, 5)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 60 for i in [*range(60, 90), 100]} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rolled_hashes():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 5, 300).astype(np.uint64)
    for n in (1, 2, 3, 5, 8, 13, 35):
        h, seen = rolled(x, n), {}
        assert len(h) == len(x) - n + 1
        for i, v in enumerate(h.tolist()):
            assert seen.setdefault(v, tuple(x[i : i + n])) == tuple(x[i : i + n])
        assert len(seen) == len({tuple(x[i : i + n]) for i in range(len(h))})


def test_wavelet_ranks():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 11, 500)
    w = fm_index.WaveletMatrix(x, 4)
    at, c = rng.integers(0, 501, 400), rng.integers(0, 16, 400)
    assert w.rank(c, at).tolist() == [int((x[:a] == s).sum()) for a, s in zip(at, c, strict=True)]


def test_matching_counts_windows():
    rng = np.random.default_rng(4)
    pieces = [rng.integers(1, 3, rng.integers(1, 40)) for _ in range(60)]
    text = np.concatenate([x for p in pieces for x in (p, [0])])
    for depth in (2, 3, 5, 8):
        index = fm_index.FmIndex(text, depth, np.ones(len(text), dtype=np.int64))
        counts = Counter(tuple(p[i : i + depth].tolist()) for p in pieces for i in range(len(p) - depth + 1))
        for p, got in zip(pieces, index.matching(pieces), strict=True):
            assert got.tolist() == [counts[tuple(p[i : i + depth].tolist())] for i in range(len(p) - depth + 1)]


def brute_removed(rows, n):
    words = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    counts = Counter(tuple(w[k : k + n]) for _, w in words for k in range(len(w) - n + 1))
    out = []
    for i, w in words:
        gone = {j for k in range(len(w) - n + 1) if counts[tuple(w[k : k + n])] > 1 for j in range(k, k + n)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("n", [35, 8, 1])
def test_removed_words(spark, n):
    rows = awkward(corpus(7, 50))
    got = S.removed(frame(spark, rows), n).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got) == brute_removed(rows, n)


def test_frequent_anchors_are_routed_by_window(spark, monkeypatch):
    monkeypatch.setattr(S, "FREQUENT", 1)
    monkeypatch.setattr(S, "SHARDS", 10_000)
    rows = corpus(8, 40)
    got = S.removed(frame(spark, rows), 12).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got) == brute_removed(rows, 12)


def test_empty(spark):
    docs = frame(spark, corpus()).limit(0)
    assert S.removed(docs).count() == 0 and J.linked(docs).count() == 0
