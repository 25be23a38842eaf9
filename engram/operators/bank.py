"""The note table: reads, and set-based writes that give a new table.

A write never changes the table it reads: upserts, patches and deletes are joins whose result is saved as a new
version, and ``Store`` points readers to the latest whole version. A null bank is a bank like others in a Store, and matches no other in
upserts, patches and deletes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.schema import NOTE

PATCHABLE = ("content", "ts", "keywords", "tags", "description", "embedding", "links", "intent", "utility")


def list_notes(notes: DataFrame) -> DataFrame:
    """All notes in scan order, the order of last writes."""
    return notes.orderBy("bank_id", "write_seq")


def get_note(notes: DataFrame, note_id: str) -> DataFrame:
    return notes.where(F.col("id") == note_id)


def get_notes(notes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Notes for wanted (bank_id, ids), in the order of ids; unknown ones are skipped."""
    asked = wanted.select("bank_id", F.posexplode("ids").alias("position", "id"))
    return asked.join(notes, ["bank_id", "id"])


def checked_dim(notes: DataFrame, dim: int) -> DataFrame:
    """notes, failing on any embedding of another length when it is read."""
    ok = F.size("embedding") == dim
    return notes.withColumn("embedding", F.when(F.assert_true(ok, "embedding length").isNull(), F.col("embedding")))


def _last(writes: DataFrame) -> DataFrame:
    """Of several writes to one note the last."""
    order = W.partitionBy("bank_id", "id").orderBy(F.desc("write_seq"))
    return writes.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def upsert(notes: DataFrame, writes: DataFrame) -> DataFrame:
    """Whole-row upsert by (bank_id, id); writes carry write_seq values above the table's, so they come last in scans."""
    new = _last(writes)
    return notes.join(new, ["bank_id", "id"], "left_anti").unionByName(new.select(*notes.columns))


def next_seq(notes: DataFrame) -> DataFrame:
    """(bank_id, base): the greatest write_seq of each bank."""
    return notes.groupBy("bank_id").agg(F.max("write_seq").alias("base"))


def numbered(notes: DataFrame, writes: DataFrame, order: list[Column]) -> DataFrame:
    """writes with write_seq after the table's, in the given order within their bank."""
    k = F.row_number().over(W.partitionBy("bank_id").orderBy(*order))
    return writes.drop("write_seq").withColumn("_k", k).join(next_seq(notes), "bank_id", "left").withColumn("write_seq", (F.coalesce("base", F.lit(0)) + F.col("_k")).cast("long")).drop("base", "_k")


def patch(notes: DataFrame, deltas: DataFrame) -> DataFrame:
    """deltas (bank_id, id, write_seq, some patchable columns): non-null values replace; an unknown id does nothing."""
    given = [c for c in deltas.columns if c in PATCHABLE]
    new = _last(deltas).select("bank_id", "id", F.lit(True).alias("_hit"), F.col("write_seq").alias("_seq"), *[F.col(c).alias(f"_{c}") for c in given])
    joined = notes.join(new, ["bank_id", "id"], "left")
    changed = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in given} | {"write_seq": F.coalesce(F.col("_seq"), F.col("write_seq"))}
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in notes.columns])


def delete(notes: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the notes of gone (bank_id, id); links to them stay, see ``dangling_links``."""
    return notes.join(gone.select("bank_id", "id").distinct(), ["bank_id", "id"], "left_anti")


def merge_update(notes: DataFrame, new: DataFrame) -> DataFrame:
    """The rows to write for new notes with target_id: the target keeps its id, links and utility, all else is new.
    Without a target, or an unknown one, the new note itself is written."""
    target = notes.select("bank_id", F.col("id").alias("target_id"), F.col("links").alias("_links"), F.col("utility").alias("_utility"), F.lit(True).alias("_hit"))
    joined = new.join(target, ["bank_id", "target_id"], "left")
    kept = {
        "id": F.when(F.col("_hit"), F.col("target_id")).otherwise(F.col("id")),
        "links": F.when(F.col("_hit"), F.col("_links")).otherwise(F.col("links")),
        "utility": F.when(F.col("_hit"), F.col("_utility")).otherwise(F.col("utility")),
    }
    return joined.select(*[kept.get(c, F.col(c)).alias(c) for c in new.columns if c != "target_id"])


def edges(notes: DataFrame) -> DataFrame:
    return notes.select("bank_id", F.col("id").alias("src"), F.explode("links").alias("dst"))


def dangling_links(notes: DataFrame) -> DataFrame:
    """Links to notes that are not there."""
    return edges(notes).join(notes.select("bank_id", F.col("id").alias("dst")), ["bank_id", "dst"], "left_anti").select("bank_id", "src", "dst")


def bucket_of(columns: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


class Store:
    """Versions of a note table under a folder, of which a write makes anew only the buckets that it touches.

    Notes lie in buckets by their bank (or by ``by``, so that one huge bank is spread), in files sorted by bank and id with a Bloom
    filter on the id. Version n is the file <path>/commits/<n>.json: the folder of each bucket, and the marks. It is published by a rename
    that fails where the number is taken, so of two writers the later one fails and readers see whole versions only; what a
    failed write left is in no version."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, by: tuple[str, ...] = ("bank_id",)):
        self.spark, self.path, self.buckets, self.by = spark, path.rstrip("/"), buckets, by
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, *parts: str) -> JavaObject:
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _fs(self) -> JavaObject:
        return self._at().getFileSystem(self._conf)

    def versions(self) -> list[int]:
        fs, top = self._fs(), self._at("commits")
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n[:1].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "folders": bucket -> folder, "marks": name -> number, "buckets", "by"} of a version, by default the latest; of none
        there are no folders."""
        found = self.versions() if version is None else [version]
        if not found:
            return {"version": 0, "folders": {}, "marks": {}, "buckets": self.buckets, "by": list(self.by)}
        stream = self._fs().open(self._at("commits", f"{found[-1]}.json"))
        try:
            return {"version": found[-1], **json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))}
        finally:
            stream.close()

    def mark(self, name: str) -> int | None:
        """The number last saved under a name, None if there is none."""
        return self.manifest()["marks"].get(name)

    def _read(self, folders: dict[str, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], NOTE)
        return self.spark.read.schema(NOTE).parquet(*[f"{self.path}/data/{f}/bucket={b}" for b, f in sorted(folders.items())])

    def load(self, version: int | None = None) -> DataFrame:
        """A version, by default the latest; an empty table if there is none."""
        return self._read(self.manifest(version)["folders"])

    def get(self, bank_id: str, *ids: str) -> DataFrame:
        """Notes of a bank by id: of one bucket, or the ids' buckets, are those row groups read that may hold them."""
        now = self.manifest()
        asked = self.spark.createDataFrame([(bank_id, i) for i in ids], "bank_id string, id string")
        touched = {str(r[0]) for r in asked.select(bucket_of(tuple(now["by"]), now["buckets"])).distinct().collect()}
        return self._read({b: f for b, f in now["folders"].items() if b in touched}).where((F.col("bank_id") == bank_id) & F.col("id").isin(*ids))

    def _publish(self, base: dict, changed: dict[str, str | None], mark: tuple[str, int] | None) -> None:
        folders = {b: f for b, f in (base["folders"] | changed).items() if f}
        body = {"folders": folders, "marks": base["marks"] | (dict([mark]) if mark else {}), "buckets": base["buckets"], "by": base["by"]}
        fs, own = self._fs(), self._at("commits", f"_{uuid.uuid4().hex}")
        out = fs.create(own)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        # Unlike the file system's own rename, this fails where the target is there.
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        try:
            context.rename(own, self._at("commits", f"{base['version'] + 1}.json"), self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception:
            fs.delete(own, False)
            raise

    def _write(self, notes: DataFrame, base: dict) -> dict[str, str]:
        """The folder of each bucket that notes have rows in."""
        own, fs = uuid.uuid4().hex, self._fs()
        rows = notes.withColumn("bucket", bucket_of(tuple(base["by"]), base["buckets"])).hint("rebalance", "bucket").sortWithinPartitions("bucket", "bank_id", "id")
        try:
            rows.write.option("parquet.bloom.filter.enabled#id", "true").partitionBy("bucket").parquet(f"{self.path}/data/{own}")
        except Exception:
            fs.delete(self._at("data", own), True)
            raise
        names = [s.getPath().getName() for s in fs.listStatus(self._at("data", own))]
        return {n.removeprefix("bucket="): own for n in names if n.startswith("bucket=")}

    def save(self, notes: DataFrame, mark: tuple[str, int] | None = None) -> DataFrame:
        """A version of these notes alone. mark (name, number) is published with it."""
        base = self.manifest()
        self._publish(base, dict.fromkeys(base["folders"]) | self._write(notes, base), mark)
        return self.load()

    def change(self, writes: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], mark: tuple[str, int] | None = None) -> DataFrame:
        """A version in which the buckets of writes (bank_id, and id if buckets go by it) are what ``how`` (their notes, writes) gives; all
        others are taken over. The driver sees the numbers of the buckets touched."""
        base = self.manifest()
        touched = [str(r[0]) for r in writes.select(bucket_of(tuple(base["by"]), base["buckets"])).distinct().collect()]
        new = {}
        if touched:
            new = self._write(how(self._read({b: f for b, f in base["folders"].items() if b in touched}), writes), base)
            if stray := new.keys() - set(touched):
                raise ValueError(f"writes to buckets that they do not name: {sorted(stray)}")
        self._publish(base, dict.fromkeys(touched) | new, mark)
        return self.load()

    def upsert(self, writes: DataFrame, mark: tuple[str, int] | None = None) -> DataFrame:
        return self.change(writes, upsert, mark)

    def vacuum(self, keep: int = 1) -> None:
        """Remove all versions but the last ``keep``, and folders that none of those names. Not while a write is under way."""
        found, fs = self.versions(), self._fs()
        used = {f for v in found[-keep:] for f in self.manifest(v)["folders"].values()}
        for v in found[:-keep]:
            fs.delete(self._at("commits", f"{v}.json"), False)
        top = self._at("data")
        for s in fs.listStatus(top) if fs.exists(top) else []:
            if s.getPath().getName() not in used:
                fs.delete(s.getPath(), True)
