"""Workers of the language model give back what is not in work."""

import pickle

import pyarrow as pa

from engram.llm import common, lang_id


def test_counting_clears_what_another_operator_remembers(monkeypatch):
    monkeypatch.setattr(common, "_memories", {})
    kept = {"a": 1}
    common.claim("other", kept.clear)
    rows = pa.RecordBatch.from_pydict({"lang": pa.array([0], pa.int32()), "text": ["one two"], "times": [1]})
    assert sum(b.num_rows for b in lang_id._count(iter([rows]))) > 0
    assert not kept


def test_each_part_of_a_batch_gives_memory_back(monkeypatch):
    model = lang_id.Model(["a", "b"], [1, 1], [(0, 0, "x", 5), (1, 0, "y", 5)], {(0, 0): 5, (1, 0): 5})
    texts = ["x x", None, "y", "x y y", "7", "zz"]
    given = []
    monkeypatch.setattr(lang_id, "AT_ONCE", 2)
    monkeypatch.setattr(lang_id, "give_back", lambda collect=True: given.append(collect))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(6)), "text": pa.array(texts)})
    found = [(b.num_rows, x) for b, x in lang_id._predicted(iter([batch]), 1, pickle.dumps(model))]
    assert [n for n, _ in found] == [2, 2, 2] and given == [False] * 3
    assert [f for _, x in found for f in x] == model.predict_all(texts)
