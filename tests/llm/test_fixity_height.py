"""Archives longer than LEVELS levels hold: one root of each archive, each finding once."""

from collections import Counter

from engram.llm import fixity


def test_long_archives_have_one_root(spark, monkeypatch):
    for name, value in (("DIGITS", 1), ("RANGE", 256), ("FANOUT", 2)):
        monkeypatch.setattr(fixity, name, value)
    pages = spark.createDataFrame([(i, f"http://x/{i}", "text " * (i % 40)) for i in range(600)], "page_id long, url string, html string")
    rows = fixity.records(pages)
    primary = fixity.placed(rows)
    replica = fixity.placed(fixity.damaged(rows)).where("NOT gone").drop("gone")
    found = fixity.audit(primary, replica).collect()
    a, b = ({(r["archive"], r["offset"]): r["sha"] for r in t.collect()} for t in (primary, replica))
    assert max(at for _, at in a) >= 256 * 2**fixity.LEVELS
    expected = Counter((k, x, b.get(k)) for k, x in a.items() if b.get(k) != x)
    assert expected and Counter(((r["archive"], r["offset"]), r["primary_sha256"], r["replica_sha256"]) for r in found) == expected
    assert all(len({r[c] for r in found if r["archive"] == x}) == 1 for x in {r["archive"] for r in found} for c in ("primary_root", "replica_root"))
