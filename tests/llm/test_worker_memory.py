"""Workers of BPE and of exact dedup hold little between tasks and nothing of other operators."""

import pyarrow as pa

from engram.llm import bpe, common, exact_dedup


def test_bpe_gives_memory_back_when_a_task_ends(monkeypatch):
    vocabulary = bpe.Bpe(bpe.vocabulary_text())
    texts = ["One two, three.", None, "", "two  two\n\nx", "\u00e9 <|endoftext|> 12" * 50]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5)), "text": pa.array(texts)})
    given = []
    monkeypatch.setattr(bpe, "AT_ONCE", 20)
    monkeypatch.setattr(bpe, "give_back", lambda collect=True: given.append(collect))
    found = [r for b in bpe._digested(iter([batch, batch.slice(0, 2)]), vocabulary) for r in b.to_pylist()]
    assert given[-1] and not any(given[:-1]) and len(given) > 3
    assert [r["doc_id"] for r in found] == [0, 1, 2, 3, 4, 0, 1]
    assert [r["n_tokens"] for r in found] == [len(vocabulary.encode(texts[r["doc_id"]] or "")) for r in found]


def test_bpe_remembers_a_bounded_number_of_words():
    vocabulary = bpe.Bpe(bpe.vocabulary_text())
    texts = [" ".join(f"w{k}x{j}" for k in range(20_000)) for j in range(10)]
    for t in texts:
        vocabulary.encode_batch([t])
    size = sum(m.keys.nbytes + m.known.nbytes for m in (vocabulary.units_known, vocabulary.parts_known))
    assert size < 12 << 20


def test_exact_dedup_clears_what_another_operator_remembers(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b", None]})
    for made in (exact_dedup._digests(exact_dedup.MODULI), None):
        monkeypatch.setattr(common, "_memories", {})
        kept = {"a": 1}
        common.claim("other", kept.clear)
        if made is None:
            wanted = type("Shared", (), {"value": None})
            list(exact_dedup._chunks(exact_dedup.MODULI, wanted)(iter([])))
        else:
            assert sum(b.num_rows for b in made(iter([batch]))) == 2
        assert not kept
