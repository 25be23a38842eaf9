import math
import re
from collections import Counter

import numpy as np
import pytest

from engram.operators.token_match import token_match, token_vector

ROWS = [(1, "The cat sat on the mat", "a cat is on the mat"), (2, "cats running", "the cat ran"), (3, "same words here", "same words here"), (4, None, "x"), (5, "x", ""), (6, "zzz", "qqq"), (7, "mat mat mat", "mat")]


def brute(rows):
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    refs = {r or "" for _, _, r in rows}
    df = Counter(w for r in refs for w in set(words(r)))
    idf = lambda w: 1 + math.log((len(refs) + 1) / (df[w] + 1))
    out = {}
    for k, p, r in rows:
        p, r = words(p), words(r)
        best = lambda xs, ys: sum(idf(x) * max(float(token_vector(x) @ token_vector(y)) for y in ys) for x in xs) / sum(idf(x) for x in xs)
        a, b = (best(p, r), best(r, p)) if p and r else (0.0, 0.0)
        out[k] = (a, b, 2 * a * b / (a + b) if a + b else 0.0)
    return out


def test_equals_matching_token_by_token(spark):
    got = {r["pair"]: (r["precision"], r["recall"], r["f"]) for r in token_match(spark.createDataFrame(ROWS, "pair int, prediction string, reference string")).collect()}
    want = brute(ROWS)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert got[3] == pytest.approx((1.0, 1.0, 1.0)) and 0 < got[2][2] < 1 and got[4] == got[5] == (0.0, 0.0, 0.0)


def test_vectors_have_length_one():
    assert all(np.isclose(token_vector(t) @ token_vector(t), 1.0) for t in ("a", "ab", "abc", "x" * 300))


def test_no_pairs(spark):
    assert token_match(spark.createDataFrame([], "pair int, prediction string, reference string")).collect() == []
