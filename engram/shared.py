"""Tables written to the folder that driver and executors share: they cut the lineage and survive lost executors."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="engram-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _own_dir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/engram/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(*tables: DataFrame) -> None:
    """Remove the files of tables made by written() once nothing reads them."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for top in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/engram/" in f}:
            path = sc._jvm.org.apache.hadoop.fs.Path(top)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
