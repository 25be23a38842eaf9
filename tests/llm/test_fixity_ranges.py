"""Offsets are summed up in ranges that hold like numbers of records, however the ids lie."""

import random

from pyspark.sql import functions as F

from engram.llm import fixity


def test_ids_far_apart_do_not_share_a_range(spark, monkeypatch):
    monkeypatch.setattr(fixity, "RANGES", 64)
    rng = random.Random(3)
    ids = [*range(3000), *[7] * 500, -(1 << 62), (1 << 62) + 1, 1 << 62, None]
    rng.shuffle(ids)
    rows = spark.createDataFrame([(i,) for i in ids], "page_id long")
    bounds = fixity._bounds(rows)
    assert bounds == sorted(set(bounds)) and len(bounds) < 64
    got = sorted((r["page_id"] is not None, r["page_id"] or 0, r["r"]) for r in rows.withColumn("r", fixity._range(bounds)).collect())
    numbers = [r for *_, r in got]
    assert numbers == sorted(numbers) and numbers[0] == -1 and numbers.count(-1) == 1
    others = [r for _, i, r in got if i != 7]
    assert max(others.count(r) for r in set(others)) < 3 * len(ids) / 64
    assert all((x == y) == (not any(min(i, j) <= b < max(i, j) for b in bounds)) for (_, i, x), (_, j, y) in zip(got[1:], got[2:]))


def test_ranges_without_ids(spark):
    for rows in ([], [(None,)], [(5,), (5,)]):
        df = spark.createDataFrame(rows, "page_id long")
        assert {r["r"] for r in df.withColumn("r", fixity._range(fixity._bounds(df))).collect()} <= {-1, 0}


def test_offsets_with_an_outlier(spark):
    pages = spark.createDataFrame([(i if i else 1 << 61, f"http://x/{i}", "t" * (i % 50)) for i in range(400)] + [(None, None, None)], "page_id long, url string, html string")
    placed = fixity.placed(fixity.records(pages))
    for r in placed.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("offset", "length", F.coalesce("page_id", F.lit(fixity.NO_ID)).alias("id")))).alias("x")).collect():
        at = 0
        for offset, length, _ in r["x"]:
            assert offset == at
            at += length
        assert [i for *_, i in r["x"]] == sorted(i for *_, i in r["x"])
