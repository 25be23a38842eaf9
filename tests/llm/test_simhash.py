import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from engram.llm import simhash

from .helpers import awkward, corpus, frame


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(seed, *words):
    """The engine's hash of an integer, then of each string, seeded one by the other."""
    h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]{1,16}", (text or "").lower())
    votes = [0] * 128
    for terms, weight in (([(w,) for w in words], 1), (list(zip(words, words[1:])), 3)):
        for t in terms:
            for i in range(2):
                h = hashed(i, *t)
                for b in range(64):
                    votes[64 * i + b] += weight if h >> b & 1 else -weight
    return sum(1 << b for b in range(128) if votes[b] > 0)


def test_prints_and_edited_texts_equal_brute_force(spark):
    rows = [r for r in corpus(8, 60) if not r[1] or len(r[1]) < 60_000]
    got = {r["doc_id"]: r for r in simhash.compared(frame(spark, rows)).collect()}
    rows.sort()
    prints = [brute_print(t) for _, t, *_ in rows]
    assert len(got) == len(rows)
    for k, (i, text, *_) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        edit = text[: len(text) - cut] + after[:cut]
        r, e, p = got[i], brute_print(edit), prints[k]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        assert r["fingerprint"] == f"{p:032x}" and r["edited_fingerprint"] == f"{e:032x}"
        assert r["near_edited"] == 1 - (p ^ e).bit_count() / 128
        assert r["near_next"] == 1 - (p ^ prints[(k + 1) % len(rows)]).bit_count() / 128
        assert r["n_near"] == sum((p ^ q).bit_count() <= 3 for q in prints) - 1


@pytest.mark.parametrize(("radius", "blocks", "part"), [(3, 4, 512), (3, 4, 16), (2, 5, 512), (5, 7, 32), (0, 1, 512)])
def test_radius_search_equals_brute_force(spark, monkeypatch, radius, blocks, part):
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(radius)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(128)
        prints |= {base} | {base ^ sum(1 << b for b in rng.sample(range(128), rng.randint(1, 6))) for _ in range(25)}
    base = rng.getrandbits(128)  # many that share three blocks of four
    prints |= {base ^ (x << 96) for x in rng.sample(range(1 << 12), 150)}
    docs = {p: rng.randint(1, 3) for p in prints}
    table = spark.createDataFrame([(signed(p & (1 << 64) - 1), signed(p >> 64), n) for p, n in docs.items()], "f0 long, f1 long, n long").repartition(3)
    got = {((r["f1"] % (1 << 64)) << 64) | r["f0"] % (1 << 64): r["near"] for r in simhash.neighbours(table, radius, blocks).collect()}
    want = {p: sum(n for q, n in docs.items() if q != p and (p ^ q).bit_count() <= radius) for p in prints}
    assert got == {p: n for p, n in want.items() if n}


def test_blocks_must_exceed_the_radius(spark):
    with pytest.raises(ValueError):
        simhash.neighbours(spark.createDataFrame([], "f0 long, f1 long, n long"), 3, 3)


def test_nulls_repeats_and_one_hot_id(spark):
    rows = awkward([r for r in corpus(9, 30) if not r[1] or len(r[1]) < 60_000])
    rows += [(7, f"text {k} under one id", "en", "s1") for k in range(80)] + [(None, f"text {k} without an id", "en", "s1") for k in range(40)]
    table = simhash.edited(frame(spark, rows)).cache()
    got = table.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(((i, t or "") for i, t, *_ in rows), key=repr)
    numbers = {r["row"]: r for r in got}
    assert len(numbers) == len(rows) and sorted(r["next"] for r in got) == sorted(numbers)  # one circle of all rows
    at, walked = min(numbers), []
    for _ in got:
        walked.append(numbers[at]["doc_id"])
        after = numbers[numbers[at]["next"]]["text"]
        text, cut = numbers[at]["text"], len(numbers[at]["text"]) // 4
        assert numbers[at]["edited"] == text[: len(text) - cut] + after[:cut]
        at = numbers[at]["next"]
    assert walked == sorted(walked, key=lambda i: (i is None, i or 0))
    one = simhash.compared(frame(spark, rows)).groupBy("fingerprint").agg(F.count("*").alias("n")).agg(F.sum("n")).first()[0]
    assert one == len(rows)


def test_empty_and_single(spark):
    assert simhash.compared(frame(spark, [])).collect() == []
    (r,) = simhash.compared(frame(spark, [(5, "abcdefgh", None, None)])).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and r["near_next"] == 1.0 and r["n_near"] == 0
