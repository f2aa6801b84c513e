"""Content-addressed versions of corpora: Parquet objects by digest and an index of versions with their parents."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark import safety
from siftmark.operators.records import digest

@dataclass(frozen=True)
class Version:
    digest: str
    tag: str
    parent_digest: str | None
    transform_name: str
    n_records: int
    created_at: float


class Store:
    """A store below ``root`` on any Hadoop file system; objects are written once and never changed, the index is replaced in one step."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        root = root if "://" in root or root.startswith("file:") else Path(root).resolve().as_uri()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)
        self._fs.mkdirs(self._path("objects"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[Version]:
        index = self._path("index.json")
        if not self._fs.exists(index):
            return []
        stream = self._fs.open(index)
        try:
            return [Version(**v) for v in json.loads(bytes(stream.readAllBytes()).decode())]
        finally:
            stream.close()

    def _replace_index(self, versions: list[Version]) -> None:
        tmp = self._path(f"index.json.{uuid.uuid4().hex}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps([asdict(x) for x in versions], indent=1).encode()))
        out.close()
        fs = self._jvm.org.apache.hadoop.fs
        overwrite = self._jvm.java.util.Collections.singletonList(getattr(fs, "Options$Rename").OVERWRITE)
        array = self._jvm.java.lang.reflect.Array.newInstance(overwrite.get(0).getClass(), 1)
        array[0] = overwrite.get(0)
        fs.FileContext.getFileContext(tmp.toUri(), self._conf).rename(tmp, self._path("index.json"), array)

    def path_for(self, d: str) -> str:
        return f"{self.root}/objects/{safety.digest(d)}"

    def commit(self, df: DataFrame, tag: str, parent: str | None = None, transform: str = "ingest") -> Version:
        """Write ``df`` unless its object is there, and add or replace the version with this digest and tag."""
        safety.reference(tag)
        s = digest(df).first()
        to = self.path_for(s["digest"])
        if not self._fs.exists(self._path(f"objects/{s['digest']}/_SUCCESS")):
            df.write.mode("overwrite").parquet(to)
        v = Version(s["digest"], tag, self.resolve(parent).digest if parent else None, transform, s["records"], time.time())
        self._replace_index([*(x for x in self.versions() if (x.digest, x.tag) != (v.digest, v.tag)), v])
        return v

    def resolve(self, reference: str) -> Version:
        """A version by tag, digest or the beginning of one; the latest wins."""
        safety.reference(reference)
        found = [v for v in self.versions() if v.tag == reference or v.digest.startswith(reference)]
        if not found:
            raise KeyError(reference)
        return max(found, key=lambda v: v.created_at)

    def load(self, spark: SparkSession, reference: str) -> DataFrame:
        return spark.read.parquet(self.path_for(self.resolve(reference).digest))

    def verify(self, spark: SparkSession, reference: str) -> bool:
        """Whether the stored object still has its digest."""
        v = self.resolve(reference)
        s = digest(self.load(spark, reference)).first()
        return (s["digest"], s["records"]) == (v.digest, v.n_records)


def lineage(versions: DataFrame, tag: str) -> DataFrame:
    """``depth, digest, parent_digest, transform_name``: a version and its ancestors; a cycle ends at the first repetition."""
    spark = versions.sparkSession
    levels = versions.select("digest").distinct().count() + 1  # no chain without a repetition is longer
    base = versions.groupBy("digest").agg(F.min("parent_digest").alias("parent_digest"), F.min("transform_name").alias("transform_name"))
    base.createOrReplaceTempView("siftmark_versions")
    start = versions.where(F.col("tag") == tag).agg(F.max_by("digest", F.struct("created_at", "digest")).alias("digest"))
    start.createOrReplaceTempView("siftmark_start")
    return spark.sql(f"""
        WITH RECURSIVE chain MAX RECURSION LEVEL {levels} AS (
          SELECT 0 AS depth, v.digest, v.parent_digest, v.transform_name, array(v.digest) AS seen
          FROM siftmark_versions v JOIN siftmark_start s ON v.digest = s.digest
          UNION ALL
          SELECT c.depth + 1, v.digest, v.parent_digest, v.transform_name, array_append(c.seen, v.digest)
          FROM chain c JOIN siftmark_versions v ON v.digest = c.parent_digest WHERE NOT array_contains(c.seen, v.digest)
        ) SELECT depth, digest, parent_digest, transform_name FROM chain""")
