"""Near duplicates among rows without an id, and rows whose id is used again."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import jaccard_join as J
from engram.llm import substring_dedup as S
from engram.llm.shingles import shingle_set

from .helpers import awkward, corpus, frame, prose
from .test_near_duplicates import brute_links, shingles

T = Fraction(4, 5)


def varied(words, *at):
    """The words with some of them changed."""
    return " ".join(f"changed{i}" if i in at else w for i, w in enumerate(words))


def hub(ids):
    """A text without an id, and two texts each near to it."""
    words = [f"{w}{i}" for i, w in enumerate(prose(random.Random(3), 120).split(" "))]
    return [(None, " ".join(words), "en", "s1"), (ids[0], varied(words, 30), "en", "s1"), (ids[1], varied(words, 90), "en", "s1")]


@pytest.mark.parametrize("ids", [(900, 901), (None, 901), (None, None)])
def test_links_through_a_row_without_an_id(spark, ids):
    rows = [*corpus(13, 30), *hub(ids)]
    got = J.linked(frame(spark, rows), 5, T)
    assert Counter(tuple(r) for r in got.collect()) == brute_links(rows, 5, T)


def test_a_pair_without_its_set_is_an_error(spark):
    pairs = spark.createDataFrame([(b"a", b"b")], "a binary, b binary")
    sets = spark.createDataFrame([(b"a", b"\0" * 8)], "fp binary, items binary")
    with pytest.raises(Exception, match="lacks a set"):
        J._verify(pairs, sets, T).count()


def brute_kept(rows, n, t):
    """Of each component the row with the smallest id (rows without one last, any of them); texts without words all stay."""
    label = list(range(len(rows)))
    sets = [shingles(x, n) for _, x, *_ in rows]
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * t.denominator >= (len(sets[i]) + len(sets[j]) - both) * t.numerator:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    groups = {}
    for k, row in enumerate(rows):
        groups.setdefault(label[k], []).append(row)
    return groups.values()


@pytest.mark.parametrize("ids", [(900, 901), (None, 901), (None, None)])
def test_one_row_of_each_component(spark, ids):
    rng = random.Random(5)
    a, b, c = (f"{x}{prose(rng, 60)}".split(" ") for x in "abc")
    rows = awkward(corpus(13, 30)) + hub(ids)
    rows += [(500, " ".join(a), "en", "s1"), (501, varied(a, 30), "en", "s1"), (501, " ".join(b), "en", "s1")]  # 501 on another text too
    rows += [(510, " ".join(c), "en", "s1"), (510, varied(c, 30), "en", "s1")]  # near duplicates under one id
    docs = frame(spark, rows)
    out = J.one_of_each(docs)
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert out.columns == docs.columns
    groups = list(brute_kept(rows, 5, T))
    assert sum(got.values()) == len(groups)
    for group in groups:
        left = [r for r in group if got[r[0], r[1]]]
        assert len({r[:2] for r in left}) == 1
        known = [i for i, *_ in group if i is not None]
        assert left[0][0] == (min(known) if known else None)
    assert got[501, " ".join(b)] == 1 and sum(got[510, x] for x in (" ".join(c), varied(c, 30))) == 1


def test_long_lists_of_uncounted_items_are_split(spark, monkeypatch):
    t = Fraction(1, 2)
    found = {w: int(shingle_set(w.encode(), 1)[0]) for w in (f"w{i}" for i in range(2500))}
    outside = sorted((h, w) for w, h in found.items() if not J.in_window(np.array([h], np.uint64), t)[0])
    common, *others = [w for _, w in outside]
    rows = [(i, f"{common} {others[2 * i]} {others[2 * i + 1]}", "en", "s1") for i in range(200)]
    rows += [(200, f"{rows[7][1]} more", "en", "s1")]
    longest = []
    scan = J._scan

    def watched(lists, *args, **kwargs):
        longest.append(lists.agg(F.max(F.size("members"))).first()[0])
        return scan(lists, *args, **kwargs)

    monkeypatch.setattr(J, "BLOCK", 8)
    monkeypatch.setattr(J, "_scan", watched)
    got = J.linked(frame(spark, rows), 1, t)
    assert Counter(tuple(r) for r in got.collect()) == brute_links(rows, 1, t)
    assert 2 < longest[0] < 60


@pytest.mark.parametrize("doc_id", [None, 7])
def test_places_of_rows_that_are_alike_are_kept_once(spark, doc_id):
    text = prose(random.Random(31), 200)
    rows = frame(spark, [(doc_id, text, "en", "s1")] * 500 + [(1, prose(random.Random(32), 50), "en", "s1")])
    one = S.repeated_windows(frame(spark, [(doc_id, text, "en", "s1")] * 2))[1].count()
    assert S.repeated_windows(rows)[1].count() == one
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in S.removed(rows).collect())
    assert got == {(doc_id, 200, 200): 500, (1, 50, 0): 1}
