import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from engram.llm import bpe as B
from engram.llm import token_files as TF
from engram.llm import units as U

from .helpers import awkward, corpus, frame

PARTS = ["a", "b", "the", " ", "  ", "\n", "'s", "é", "1", "!", ".", "\t", " ", "ing", "\x1f", "aa", "<|endoftext|>", "日", "²", " ", "\U0001f600"]


@pytest.fixture(scope="module")
def vocabulary():
    return B.vocabulary_text()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(B.tokenizer_path())


def samples():
    rng = random.Random(4)
    return [t or "" for _, t, *_ in corpus()] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(1500)]


def test_encoding_is_the_library_s(vocabulary, library):
    bpe = B.Bpe(vocabulary)
    for text in samples():
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text) == ids
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_token_that_is_reachable_encodes_to_itself(vocabulary, library):
    bpe = B.Bpe(vocabulary)
    for i in range(0, 50_000, 7):
        data = bpe.bytes[i]
        got = bpe.encode_piece(data)
        assert b"".join(bpe.bytes[k] for k in got) == data and (got == (i,) or (i,) not in [got])


def test_cached_words_are_the_library_s(vocabulary, library, monkeypatch):
    monkeypatch.setattr(TF, "KNOWN", 300)
    encoder = TF.LibraryEncoder(vocabulary)
    texts = samples()
    for at in range(0, len(texts), 50):
        for text, ids in zip(texts[at : at + 50], encoder.encode(texts[at : at + 50]), strict=True):
            assert np.frombuffer(ids, encoder.type).tolist() == library.encode(text, add_special_tokens=False).ids


LINES = ["a", "Bé", " the", "\n", "\n", " ", ",", "'s", "\t", "\r", "<|endoftext|>", U.MARK, "\x85", "\u2028", "7"]


def test_batches_of_odd_blanks_and_line_ends_are_the_library_s(vocabulary, library, monkeypatch):
    monkeypatch.setattr(TF, "KNOWN", 200)
    monkeypatch.setattr(B, "KNOWN_PARTS", 90)
    monkeypatch.setattr(B, "KNOWN", 200)
    rng, bpe, encoder = random.Random(5), B.Bpe(vocabulary), TF.LibraryEncoder(vocabulary)
    for _ in range(80):
        texts = ["".join(rng.choices(LINES, k=rng.randint(0, 12))) for _ in range(30)]
        expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
        ids, ends = bpe.encode_batch(texts)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == expected
        assert [np.frombuffer(x, encoder.type).tolist() for x in encoder.encode(texts)] == expected


def test_long_texts_come_in_stretches(vocabulary, library):
    text = "the of  and\nto in\n\n is " * 200 + "x" * 500 + "  y z\n"
    parts = list(U.stretches(text, 100))
    assert "".join(parts) == text and len(parts) > 30
    bpe = B.Bpe(vocabulary)
    assert [i for p in parts for i in bpe.encode(p)] == library.encode(text, add_special_tokens=False).ids
    texts = [None, text, "", "a b", text]
    back, held = [], ""
    for pieces, last in U.pieces(texts, 150):
        for p, done in zip(pieces, last, strict=True):
            held += p
            if done:
                back.append(held)
                held = ""
    assert back == [t or "" for t in texts]


def test_digests(spark, vocabulary, library):
    rows = awkward(corpus())
    got = B.digests(frame(spark, rows), vocabulary).collect()
    expected = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    order = lambda x: (x[0] is not None, x)
    assert sorted((tuple(r) for r in got), key=lambda x: str(order(x))) == sorted(expected, key=lambda x: str(order(x)))
    assert B.digests(frame(spark, rows).limit(0), vocabulary).count() == 0


def test_encode_and_decode_tables(spark, vocabulary):
    docs = frame(spark, corpus())
    back = B.decode_documents(B.encode_documents(docs, vocabulary), vocabulary)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t, *_ in corpus()}


def brute_lengths(counts, limit):
    """The least total by trying all length vectors of a small code."""
    from itertools import product

    best = None
    for lengths in product(range(1, limit + 1), repeat=len(counts)):
        if sum(2.0**-n for n in lengths) <= 1:
            cost = sum(n * c for n, c in zip(lengths, counts, strict=True))
            best = cost if best is None else min(best, cost)
    return best


def test_package_merge_is_optimal():
    rng = random.Random(6)
    for _ in range(30):
        counts = np.array([rng.choice([1, 2, 3, 50, 400, 9000]) for _ in range(rng.randint(2, 6))])
        lengths = TF.code_lengths(counts, 4)
        assert lengths.max() <= 4 and sum(2.0 ** -int(n) for n in lengths) <= 1
        assert int((lengths * counts).sum()) == brute_lengths(counts.tolist(), 4)
    assert TF.code_lengths(np.array([0, 9, 0])).tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        TF.code_lengths(np.ones(5), 2)


def test_bits_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, TF.STEP - 1, TF.STEP, TF.STEP + 1, 5000):
        ids = (rng.pareto(0.6, n) * 3).astype(np.int64) % 3000
        counts = np.bincount(ids, minlength=3000)
        lengths = TF.code_lengths(counts) if n else np.zeros(3000, np.uint8)
        bits, checkpoints, total = TF.pack(ids.astype(np.uint32), TF.canonical_codes(lengths), lengths)
        assert total == int(lengths[ids].astype(int).sum()) and len(checkpoints) == -(-n // TF.STEP)
        assert TF.Decoder(lengths).unpack(bits, checkpoints, n).tolist() == ids.tolist()


def test_token_files(spark, vocabulary, library, tmp_path, monkeypatch):
    rows = awkward(corpus())
    TF.write_token_files(frame(spark, rows), str(tmp_path / "t"), vocabulary)
    got = TF.read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    ids = [i for i in (r["doc_id"] for r in got)]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i) and len(got) == len(rows)
    at, left = 0, sorted(str((i, [*library.encode(t or "", add_special_tokens=False).ids, 0])) for i, t, *_ in rows)
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    assert sorted(str((r["doc_id"], r["ids"])) for r in got) == left
    crc = TF.read_token_files(spark, str(tmp_path / "t"), crc_only=True)
    assert sorted((r["start"], r["ids_crc32"]) for r in crc.collect()) == [(r["start"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in got]


def test_empty_token_files(spark, vocabulary, tmp_path):
    TF.write_token_files(frame(spark, corpus()).limit(0), str(tmp_path / "t"), vocabulary)
    assert TF.read_token_files(spark, str(tmp_path / "t")).count() == 0
