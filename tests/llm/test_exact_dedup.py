import hashlib
import random
from collections import Counter

import pyarrow as pa

from engram.llm import exact_dedup as X

from .helpers import awkward, corpus, frame


def test_fingerprints_combine():
    rng = random.Random(2)
    for n in (0, 1, 5, X.CHUNK - 1, X.CHUNK, X.CHUNK + 1, 3 * X.CHUNK + 17):
        data = rng.randbytes(n)
        for p, r in X.MODULI:
            h = 0
            for b in data[: 2 * X.CHUNK]:
                h = (h * r + b) % p
            got = 0
            for i in range(0, min(n, 2 * X.CHUNK), X.CHUNK):
                c = data[: 2 * X.CHUNK][i : i + X.CHUNK]
                got = X.combine(got, X.chunk_hash(c, p, r), len(c), p, r)
            assert got == h
    assert X.fingerprint(b"ab") != X.fingerprint(b"ba") and X.fingerprint(b"") == X.fingerprint(b"")


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    least = lambda x: -1 if x is None else x
    out = []
    for i, t, *_ in rows:
        ids = groups[t or ""]
        keep = max(ids, key=least)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return Counter(out)


def test_groups(spark):
    rows = awkward(corpus())
    got = X.duplicate_groups(frame(spark, rows))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_collisions_are_split(spark):
    # Every fingerprint is the same, so all texts of one length meet and are told apart by their chunks.
    same = ((1, 0), (1, 0))
    assert X.fingerprint(b"aa", same) == X.fingerprint(b"bb", same)
    long = "x" * (X.CHUNK + 7)
    rows = [(1, "aa", "en", "s"), (2, "bb", "en", "s"), (3, "aa", "en", "s"), (4, "c", "en", "s"), (5, long, "en", "s"), (6, long[:-1] + "y", "en", "s"), (7, long, "en", "s"), (8, None, "en", "s"), (9, "", "en", "s")]
    digests = X._digests(same)(iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["aa", "bb"])], ["doc_id", "text"])]))
    assert len(set(next(digests).column(1).to_pylist())) == 1
    assert Counter(tuple(r) for r in X.duplicate_groups(frame(spark, rows), same).collect()) == brute(rows)


def test_deduplicate_keeps_columns_and_one_row_each(spark):
    rows = awkward(corpus())
    docs = frame(spark, rows)
    got = X.deduplicate(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    assert Counter(r["text"] or "" for r in kept) == Counter({t or "": 1 for _, t, *_ in rows})
    last = {}
    for i, t, *_ in rows:
        last[t or ""] = max(last.get(t or "", -1), -1 if i is None else i)
    assert all((-1 if r["doc_id"] is None else r["doc_id"]) == last[r["text"] or ""] for r in kept)


def test_empty(spark):
    docs = frame(spark, corpus()).limit(0)
    assert X.duplicate_groups(docs).count() == 0 and X.deduplicate(docs).count() == 0
