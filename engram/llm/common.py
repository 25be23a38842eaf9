"""Helpers shared by the corpus operators: the shared folder, written tables, text columns."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="engram-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _own_dir()
    return found.rstrip("/")


def written(df: DataFrame, name: str, sort: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/engram/{name}-{uuid.uuid4().hex}"
    if sort:
        df = df.sortWithinPartitions(*sort)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, df: DataFrame) -> None:
    """Remove the files of a table made by written() once nothing reads it."""
    jvm = spark.sparkContext._jvm
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/engram/" in top:
            path = jvm.org.apache.hadoop.fs.Path(top)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps that are done: its cleaner acts when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: str | Column = "text") -> Column:
    """Words of a text (null: 0), JVM-side."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[str]:
    """The words in order; str.split() would also cut at other blanks."""
    if not text:
        return []
    if "\x0b" in text or "\x0c" in text or "\r" in text or "\t" in text:
        text = text.translate({9: 32, 11: 32, 12: 32, 13: 32})
    return [w for w in text.replace("\n", " ").split(" ") if w]


def bucket_of(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def integer_ids(df: DataFrame, column: str) -> DataFrame:
    """The id column as long, whatever integer type it came in; what Python then gets of df comes in small batches, as a text can
    be long."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2048), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        if not 0 < int(re.sub(r"\D", "", df.sparkSession.conf.get(key)) or 0) <= most:
            df.sparkSession.conf.set(key, str(most))
    return df.withColumn(column, F.col(column).cast("long"))


_memories: dict[str, Callable[[], None]] = {}


def claim(owner: str, clear: Callable[[], None]) -> None:
    """A Python worker keeps what one operator remembers: an operator that begins in it clears the others', and the memory they
    took goes back to the system."""
    others = [n for n in _memories if n != owner]
    for name in others:
        _memories.pop(name)()
    if others:
        give_back()
    _memories[owner] = clear


def give_back(collect: bool = True) -> None:
    """Return freed memory of Python, Arrow and the C library to the system; without ``collect`` it takes a few milliseconds."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
