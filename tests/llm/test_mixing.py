import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from engram.llm import mixing as M

from .helpers import awkward, corpus, frame


def goals(rows):
    """Targets by resharing the excess again and again."""
    size = defaultdict(int)
    for _, t, _, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), float(sum(size.values())), set(order)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * size[s]}
        if not over:
            for s in free:
                target[s] = left * weight[s] / total
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        free -= over
    return size, target


@pytest.mark.parametrize("block", [7, 4096])
def test_taken(spark, block):
    rows = awkward(corpus())
    got = M.taken(frame(spark, rows), block)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken", "first_slot"]
    again = Counter(tuple(r) for r in M.taken(frame(spark, rows), block).collect())
    found = got.collect()
    assert Counter(tuple(r) for r in found) == again and len(found) == len(rows)
    size, target = goals(rows)
    sums, words = defaultdict(float), defaultdict(int)  # by target and size, as the source does not show
    for s in size:
        sums[round(target[s], 6), size[s]] += target[s]
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"]
        words[round(r["target"], 6), r["source_size"]] += r["taken"]
    assert words.keys() == sums.keys() and all(abs(words[k] - sums[k]) <= len(size) for k in sums)


def test_schedule_is_of_low_discrepancy(spark):
    rows = corpus()
    goal = M.targets(M.sizes(frame(spark, rows)))
    made = M.slots(goal, 5).orderBy("slot").collect()
    need = {r["source"]: -(-r["quota"] // 5) for r in goal.collect()}
    assert Counter(r["source"] for r in made) == Counter({s: n for s, n in need.items() if n})
    seen = defaultdict(int)
    for k, r in enumerate(made[: len(made) * 9 // 10]):
        assert r["r"] == seen[r["source"]]
        seen[r["source"]] += 1
        share = need[r["source"]] / sum(need.values())
        assert abs(seen[r["source"]] - share * (k + 1)) < 6


def schedule(goal, block):
    """(slot, source, r) by whole-number arithmetic."""
    quotas = [(r["source"], r["quota"]) for r in sorted(goal, key=lambda r: r["place"])]
    n, total, made, seen = sum(-(-q // block) for _, q in quotas), sum(q for _, q in quotas), [], Counter()
    for slot in range(n):
        u, upto = slot * M.GOLDEN % (1 << M.BITS) / (1 << M.BITS), 0
        for s, q in quotas:
            upto += q
            if (upto - q) / total <= u < upto / total:
                if seen[s] < -(-q // block):
                    made.append((slot, s, seen[s]))
                seen[s] += 1
    late = [(n + r * len(quotas) + k, s, r) for k, (s, q) in enumerate(quotas) for r in range(seen[s], -(-q // block))]
    return made + late


def test_slots_and_first_slots(spark, monkeypatch):
    rows = awkward(corpus())
    docs = frame(spark, rows)
    goal = M.targets(M.sizes(docs))
    made = schedule(goal.collect(), 7)
    assert Counter(tuple(r) for r in M.slots(goal, 7).collect()) == Counter(made) and len({s for s, _, _ in made}) == len(made)
    pieces = M.blocks(docs, 7).collect()
    words = Counter()
    for p in pieces:
        words[p["slot"]] += p["words"]
    assert set(words) == {s for s, _, _ in made} and max(words.values()) == 7 and sum(words.values()) == sum(r["quota"] for r in goal.collect())
    first = {}
    for p in pieces:
        first[p["doc_id"]] = min(p["slot"], first.get(p["doc_id"], p["slot"]))
    got = {}
    for r in M.taken(docs, 7).collect():
        assert (r["first_slot"] < 0) == (r["taken"] == 0)
        if r["taken"]:
            got[r["doc_id"]] = min(r["first_slot"], got.get(r["doc_id"], r["first_slot"]))
    assert got == first
    before = Counter(tuple(r) for r in M.taken(docs, 7).select("doc_id", "taken", "first_slot").collect())
    monkeypatch.setattr(M, "GOLDEN", M.GOLDEN // 3)
    after = Counter(tuple(r) for r in M.taken(docs, 7).select("doc_id", "taken", "first_slot").collect())
    assert before != after and Counter(x[:2] for x in before.elements()) == Counter(x[:2] for x in after.elements())


def test_points_of_great_slot_numbers(spark):
    numbers = [0, 1, 2**32 + 1, 2**40 + 3, 2**62]
    got = spark.createDataFrame([(i,) for i in numbers], "id long").select("id", M.point(F.col("id")).alias("u")).collect()
    assert {r["id"]: r["u"] for r in got} == {i: i * M.GOLDEN % (1 << M.BITS) / (1 << M.BITS) for i in numbers}


def test_any_stretch_of_the_mix_has_the_targets(spark):
    rows = corpus(n=200)
    docs = frame(spark, rows)
    pieces = sorted(M.blocks(docs, 20).collect(), key=lambda p: p["slot"])
    goal = {r["source"]: r["quota"] for r in M.targets(M.sizes(docs)).collect()}
    total, at, seen = sum(goal.values()), 0, Counter()
    for p in pieces[: len(pieces) * 9 // 10]:
        at += p["words"]
        seen[p["source"]] += p["words"]
        assert all(abs(seen[s] - at * q / total) <= 6 * 20 for s, q in goal.items())
    # The mix itself: partitions are consecutive stretches of the schedule.
    first = {r["doc_id"]: r["first_slot"] for r in M.taken(docs, 20).collect()}
    parts = M.mix(docs, 20).select(F.spark_partition_id().alias("part"), "doc_id", "text").collect()
    assert len({r["part"] for r in parts}) > 1
    once = Counter(r["doc_id"] for r in parts)
    ordered = [first[r["doc_id"]] for r in sorted(parts, key=lambda r: r["part"]) if once[r["doc_id"]] == 1]
    assert ordered == sorted(ordered)


def test_mix_of_rows_that_are_alike(spark):
    rows = [(1, "a b c d e", "en", "s")] * 3 + [(1, "f g h i j", "en", "s"), (None, "k l", "en", None), (None, "k l", "en", None), (2, "m " * 40, "en", "t")]
    docs = frame(spark, rows)
    want = Counter()
    for r in M.taken(docs).collect():
        want[r["doc_id"], r["size"]] += r["taken"]
    mixed = M.mix(docs).collect()
    assert sum(len(r["text"].split()) for r in mixed) == sum(want.values()) and len({r["text"] for r in mixed}) >= 3


def test_mix_repeats_documents(spark):
    rows = corpus()
    docs = frame(spark, rows)
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    share = {r["doc_id"]: (r["taken"], r["size"]) for r in M.taken(docs).collect()}
    words, text = defaultdict(int), {i: t for i, t, *_ in rows}
    for r in mixed.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        words[r["doc_id"]] += n
        assert r["text"] == text[r["doc_id"]] or (n < share[r["doc_id"]][1] and r["n_chars"] == len(r["text"]))
    assert words == {i: t for i, (t, _) in share.items() if t}


def test_empty_and_blank(spark):
    docs = frame(spark, corpus())
    assert M.taken(docs.limit(0)).count() == 0 and M.mix(docs.limit(0)).count() == 0
    blank = frame(spark, [(1, None, None, None), (2, " ", None, "s")])
    assert [r["taken"] for r in M.taken(blank).collect()] == [0, 0] and M.mix(blank).count() == 0


def test_no_python_in_the_plan(spark):
    plan = M.taken(frame(spark, corpus()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
