import hashlib
import os
from collections import Counter, defaultdict
from fractions import Fraction

from tokenizers import Tokenizer

import corpus_pipeline as C
from engram.llm import bpe, lang_id

from .helpers import corpus, frame
from .test_mixing import goals
from .test_near_duplicates import brute_links

ORDER = ["language_id", "exact_dedup", "jaccard_join", "mix_sources", "bpe_encode"]


def stages(spark, docs, tmp_path):
    out = []
    for k, (name, f) in enumerate(C.STAGES):
        f(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        out.append((name, docs.columns, docs.collect()))
    return out


def test_each_stage_against_brute_force(spark, tmp_path):
    rows = corpus(11, 70)
    docs = frame(spark, rows)
    made = stages(spark, docs, tmp_path)
    assert [n for n, *_ in made] == ORDER and all(c == docs.columns for _, c, _ in made[:4])
    model = lang_id.train(docs, ~lang_id.held_out())
    sure = {r["doc_id"] for r in lang_id.predict(docs, model).collect() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    left = [r for r in rows if r[0] in sure]
    assert {r["doc_id"] for r in made[0][2]} == {r[0] for r in left}
    last = {}
    for i, t, *_ in left:
        last[t] = max(i, last.get(t, i))
    left = [r for r in left if last[r[1]] == r[0]]
    assert {r["doc_id"] for r in made[1][2]} == {r[0] for r in left}
    stay = {c for _, _, c in brute_links(left, 5, Fraction(4, 5))}
    left = [r for r in left if r[0] in stay]
    assert {r["doc_id"] for r in made[2][2]} == {r[0] for r in left}
    _, target = goals(left)
    words = defaultdict(int)
    for r in made[3][2]:
        words[r["source"]] += len(r["text"].encode().split())
    assert all(abs(words[s] - target[s]) <= 1 for s in target)
    library = Tokenizer.from_file(bpe.tokenizer_path())
    expected = Counter()
    for r in made[3][2]:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        expected[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in made[4][2]) == expected


def test_empty_tables_pass_through(spark, tmp_path):
    assert [len(r) for *_, r in stages(spark, frame(spark, corpus()).limit(0), tmp_path)] == [0] * 5


def test_run(spark, tmp_path):
    frame(spark, corpus(12, 30)).write.parquet(str(tmp_path / "documents.parquet"))
    got = C.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 10
    assert os.path.isdir(tmp_path / "documents.parquet")
