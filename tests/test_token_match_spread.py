from engram.operators import token_match as tm

from .test_token_match import ROWS, brute


def test_texts_are_counted_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(tm, "CHARACTERS", 20)
    rows = [*ROWS, *[(100 + k, f"word{k} cats of {k}", "the cat ran") for k in range(40)]]
    pairs = spark.createDataFrame(rows, "pair int, prediction string, reference string").coalesce(1)
    texts = pairs.na.fill("")
    size = sum(len(p or "") + len(r or "") for _, p, r in rows)
    parts = [p for p in tm._spread(texts, "pair").rdd.glom().collect() if p]
    assert tm._spread(texts, "pair").rdd.getNumPartitions() == -(-size // 20) and max(map(len, parts)) <= 8
    got = {r["pair"]: r["f"] for r in tm.token_match(pairs).collect()}
    assert all(abs(got[k] - v[2]) < 1e-9 for k, v in brute(rows).items()) and len(got) == len(rows)


def test_tokens_are_counted_without_another_exchange_of_them(spark, monkeypatch):
    """A text's tokens stay where the text is until their weights are joined: one exchange by key comes before the counts."""
    monkeypatch.setattr(tm, "CHARACTERS", 20)
    plan = tm.token_match(spark.createDataFrame(ROWS, "pair int, prediction string, reference string"))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(pair" in line]
    assert any("REPARTITION_BY_NUM" in line for line in exchanges) and not any("side" in line for line in exchanges)
