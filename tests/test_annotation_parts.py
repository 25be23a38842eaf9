"""An annotation set written as one JSON array by many tasks."""

import glob
import json

from engram.sources import files

SCHEMA = files.ANNOTATION
ROWS = [(f"{k:03d}", f"q{k}", ["a\nb", "[,]"], "r", [("s", f"x{k}\r\n"), ("t", "]")]) for k in range(200)]


def text_of(path):
    return "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{path}/part-*")))


def test_parts_are_one_array_in_the_order_of_ids(spark, tmp_path, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    rows = [*ROWS, ROWS[0], ROWS[7], (None, None, None, None, None)]
    path = str(tmp_path / "set")
    files.write_annotations(spark.createDataFrame(rows, SCHEMA).repartition(5), path)
    assert len(glob.glob(f"{path}/part-*")) > 1
    ids = [x.get("id") for x in json.loads(text_of(path))]
    assert ids == [None, *sorted(r[0] for r in rows if r[0])]
    back = sorted(map(repr, files.read_annotations(spark, path, lines=True).collect()))
    assert back == sorted(map(repr, spark.createDataFrame(rows, SCHEMA).collect()))


def test_equal_first_items_and_empty_sets(spark, tmp_path):
    files.write_annotations(spark.createDataFrame([ROWS[0]] * 3, SCHEMA), str(tmp_path / "same"))
    assert len(json.loads(text_of(tmp_path / "same"))) == 3
    files.write_annotations(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert json.loads(text_of(tmp_path / "none")) == []
    assert files.read_annotations(spark, str(tmp_path / "none"), lines=True).collect() == []
