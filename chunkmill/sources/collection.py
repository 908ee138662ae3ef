"""Collections: Parquet tables of records, upserted by id.

Records are dealt to buckets by a hash of the id. A version is a small table of the folders that hold its buckets; an
upsert rewrites the buckets that its ids fall into and takes the others over; a large bucket is written by several tasks. Versions are written under their number, and
a number can be created only once: of two writers that start from the same version one succeeds and the other starts
again from the new one. Readers of an old version aren't disturbed, and a failed write leaves no version. ``vacuum``
removes what no kept version needs.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import contains_or_all
from .staging import stage_table

BUCKETS = 64
#: Writers that may come first before an upsert gives up.
TRIES = 10


class Collection:
    def __init__(self, spark: SparkSession, root: str, name: str, buckets: int = BUCKETS):
        self.spark, self.base, self.name, self.buckets = spark, f"{root.rstrip('/')}/{name}", name, buckets

    def files(self, path: str):
        """Hadoop's file system of a path, and the path."""
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def names(self, path: str) -> list[str]:
        fs, at = self.files(path)
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.names(f"{self.base}/versions") if n.endswith(".json") and n[0] != ".")

    def about(self, version: int) -> dict:
        """``folders``, bucket to folder (None if the version is that of a drop), and ``sources``, a stream's name to the number of its last batch."""
        fs, at = self.files(f"{self.base}/versions/{version:012d}.json")
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def folders(self, version: int) -> dict[str, str] | None:
        return self.about(version)["folders"]

    def current(self) -> tuple[int, dict[str, str] | None, dict[str, int]]:
        """(version, folders, sources), or (0, None, {}) for a collection that isn't there."""
        found = self.versions()
        if not found:
            return 0, None, {}
        own = self.about(found[-1])
        return found[-1], own["folders"], own["sources"]

    def publish(self, version: int, folders: dict[str, str] | None, sources: dict[str, int]) -> bool:
        """Create the version, whole at once; False if another writer has created it."""
        at = f"{self.base}/versions/{version:012d}.json"
        fs, own = self.files(f"{self.base}/versions/.{uuid.uuid4().hex}")
        stream = fs.create(own, False)
        stream.write(json.dumps({"folders": folders, "sources": sources}).encode())
        stream.close()
        try:
            self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), self.spark._jsc.hadoopConfiguration()).rename(own, self.files(at)[1], self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(own, False)
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        return True

    def records(self, folders: dict[str, str]) -> DataFrame | None:
        paths = [f"{folder}/bucket={bucket}" for bucket, folder in sorted(folders.items())]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        """The records, or None for a collection that isn't there."""
        _, folders, _ = self.current()
        return None if folders is None else self.records(folders)

    def upsert(self, records: DataFrame, source: str | None = None, batch: int | None = None) -> int:
        """Records by ``id``: known ids are replaced, of equal ids in a batch the last by ``seq`` (if there) stays; a null id is an id. The number of input records.

        Batches of a ``source`` are numbered, and one whose number isn't above the last one's is left out: 0 records.
        """
        order = F.col("seq") if "seq" in records.columns else F.lit(0)
        columns = [c for c in records.columns if c not in ("id", "seq")]
        bucket = F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int").alias("bucket")
        if source is not None and self.current()[2].get(source, -1) >= batch:
            return 0
        counted = Observation()
        latest = records.observe(counted, F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in columns]), order).alias("r"))
        new = stage_table(self.spark, latest.select("id", *[F.col(f"r.`{c}`").alias(c) for c in columns]), "upsert")
        touched = {str(r[0]) for r in new.select(bucket).distinct().collect()}  # ``buckets`` numbers at most
        for _ in range(TRIES):
            version, folders, sources = self.current()
            if source is not None and sources.get(source, -1) >= batch:
                return 0
            known = folders or {}
            whole, old = new, self.records({b: f for b, f in known.items() if b in touched})
            if old is not None:
                ids = new.select(F.col("id").alias("new_id"))
                whole = old.join(ids, F.col("id").eqNullSafe(F.col("new_id")), "left_anti").unionByName(new, allowMissingColumns=True)
            out = f"{self.base}/data/{version + 1:012d}-{uuid.uuid4().hex}"
            if touched:
                whole.select("*", bucket).hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(out)
            if self.publish(version + 1, known | dict.fromkeys(touched, out), sources | ({} if source is None else {source: batch})):
                return counted.get["n"]
        raise RuntimeError(f"{self.name}: other writers came first {TRIES} times")

    def drop(self) -> str:
        """From now on the collection isn't there; its versions stay for readers that still run, until ``vacuum``."""
        for _ in range(TRIES):
            version, folders, sources = self.current()
            if folders is None or self.publish(version + 1, None, sources):
                break
        return self.name

    def vacuum(self, keep: int = 2) -> int:
        """Remove all but the last ``keep`` versions and the folders that none of them needs; the number of folders removed."""
        found = self.versions()
        needed = {folder.rsplit("/", 1)[-1] for v in found[-keep:] for folder in (self.folders(v) or {}).values()}
        newest = f"{(found[-1] if found else 0):012d}"
        for v in found[:-keep]:
            fs, at = self.files(f"{self.base}/versions/{v:012d}.json")
            fs.delete(at, False)
        gone = [n for n in self.names(f"{self.base}/data") if n not in needed and n[:12] <= newest]  # a later one may be in the making
        for n in gone:
            fs, at = self.files(f"{self.base}/data/{n}")
            fs.delete(at, True)
        return len(gone)

    def count(self) -> int:
        found = self.read()
        return 0 if found is None else found.count()


def list_documents(records: DataFrame, query: str | None = None, limit: int | None = 10) -> DataFrame:
    """Records in order of id, filtered by a substring of the document; without limit all of them."""
    found = records.filter(contains_or_all(F.col("document"), query)).withColumn("document", F.coalesce("document", F.lit(""))).orderBy("id")
    return found if limit is None else found.limit(limit)


def summary(records: DataFrame, key: str | None = None) -> DataFrame:
    """Number of records, smallest id and the length of its document."""
    first = F.min_by(F.struct("id", F.length("document").alias("chars")), "id")
    grouped = records.groupBy(*([key] if key else []))
    return grouped.agg(F.count(F.lit(1)).alias("count"), first.alias("s")).select(*([key] if key else []), "count", F.col("s.id").alias("sample_id"), F.col("s.chars").alias("sample_chars"))


def where_file(name: str | None) -> Column:
    """Metadata predicate: the file name contains a text."""
    return contains_or_all(F.col("file_name"), name)
