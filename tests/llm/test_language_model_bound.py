"""The size of the language model is bounded, whatever the labelled rows."""

import pickle

from pyspark.sql import functions as F

from engram.llm import lang_id

from .helpers import frame
from .test_language_pii_fixity_ann import labelled


def test_pieces_of_all_languages_are_bounded(spark, monkeypatch):
    docs = frame(spark, labelled())
    whole = pickle.loads(lang_id.train(docs, F.lit(True)))
    monkeypatch.setattr(lang_id, "PIECES", 2 * 6 * 7)
    small = pickle.loads(lang_id.train(docs, F.lit(True)))
    assert [len(i) <= 14 for i in small.index] == [True] * 6 and sum(map(len, small.index)) <= 84 < sum(map(len, whole.index))
    # What is kept are the most frequent pieces, at the frequency that all pieces give.
    kept, row = small.index[0], next(iter(small.index[0]))
    at = slice(small.ends[kept[row] + small.begin[0] - 1], small.ends[kept[row] + small.begin[0]])
    own = whole.index[0][row] + whole.begin[0]
    other = slice(whole.ends[own - 1], whole.ends[own])
    assert dict(zip(small.columns[at], small.above[at], strict=True)).items() <= dict(zip(whole.columns[other], whole.above[other], strict=True)).items()


def test_rows_alike_without_an_id_count_as_often_as_they_occur(spark):
    rows = [(None, "aa aa bb", "x", "s")] * 50 + [(None, "cc", "y", "s"), (1, "aa", "y", "s")]
    one = pickle.loads(lang_id.train(frame(spark, rows), F.lit(True)))
    want = lang_id.Model(["x", "y"], [50, 2], [(0, 0, "aa", 100), (0, 0, "bb", 50), (1, 0, "cc", 1), (1, 0, "aa", 1)], {(0, 0): 150, (1, 0): 2})
    assert one.index[0] == want.index[0] and one.common == 0
    last = want.begin[1]
    assert one.ends[:last].tolist() == want.ends[:last].tolist() and one.above[: want.ends[last - 1]].tolist() == want.above.tolist()


def test_many_languages_are_scored_in_slices(monkeypatch):
    model = lang_id.Model(["a", "b"], [1, 1], [(0, 0, "x", 5), (1, 0, "y", 5)], {(0, 0): 5, (1, 0): 5})
    texts = ["x x", None, "y", "x y y", "7", "zz"]
    want = model.predict_all(texts)
    monkeypatch.setattr(lang_id, "NUMBERS", 4)
    assert model.predict_all(texts) == want
