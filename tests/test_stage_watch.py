"""Rows and times of stages, from one run."""

from pyspark.sql import functions as F

from engram.profiling import StageWatch, StreamWatch, stage_means


def jobs(spark, group):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_one_run_tells_all_stages(spark):
    def plan(mark):
        rows = mark("read", spark.range(1000))
        kept = mark("keep", rows.where("id % 3 = 0"))
        none = mark("none", kept.where("id < 0"))
        return mark("group", kept.unionByName(none).groupBy((F.col("id") % 5).alias("k")).count())

    watch, counts = StageWatch(), {}
    for group, mark in (("plain", lambda stage, df: df), ("watched", watch.at)):
        spark.sparkContext.setJobGroup(group, group)
        plan(mark).write.format("noop").mode("overwrite").save()
        counts[group] = jobs(spark, group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = {r["stage"]: r for r in watch.frame(spark).collect()}
    # The plan holds ``read`` and ``keep`` twice, as ``kept`` feeds both sides of the union: one of the two is told.
    assert {k: r["rows"] for k, r in got.items()} == {"read": 1000, "keep": 334, "none": 0, "group": 5}
    assert list(got) == ["read", "keep", "none", "group"]
    assert counts["watched"] == counts["plain"]
    assert got["none"]["began_ms"] is None and got["none"]["duration_ms"] is None
    assert got["read"]["began_ms"] <= got["group"]["began_ms"] and got["read"]["duration_ms"] >= 0
    assert stage_means(watch.frame(spark)).where("stage = 'read'").first()["mean_ms"] == got["read"]["duration_ms"]


def test_empty_input(spark):
    watch = StageWatch()
    watch.at("read", spark.createDataFrame([], "id long")).write.format("noop").mode("overwrite").save()
    assert [r["rows"] for r in watch.frame(spark).collect()] == [0]


def test_stream_sums_its_batches(spark, tmp_path):
    src = tmp_path / "in"
    for k in range(3):
        spark.range(k * 10, k * 10 + 10, numPartitions=1).write.mode("append").parquet(str(src))
    watch = StreamWatch()
    spark.streams.addListener(watch)
    try:
        rows = watch.at("read", spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(src)))
        kept = watch.at("keep", rows.where("id % 2 = 0")).observe("other", F.count(F.lit(1)).alias("n"))
        q = kept.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
        got = {r["stage"]: r for r in watch.frame(spark).collect()}
    finally:
        spark.streams.removeListener(watch)
    assert {k: r["rows"] for k, r in got.items()} == {"read": 30, "keep": 15}
    assert got["read"]["began_ms"] <= got["read"]["ended_ms"]
