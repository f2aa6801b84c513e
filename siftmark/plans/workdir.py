"""Lineage cuts: tables written to the folder that every executor shares.

The folder is the one the cluster names in ``spark.checkpoint.dir``, or the context's checkpoint folder. Only a local master
without either (tests, a laptop) gets a temporary folder; a cluster without a shared folder is an error, as its executors would write
to disks of their own. A table written here survives the loss of executors, which a local checkpoint does not.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[object, str]] = []
_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("a cluster needs a folder that all executors share: set spark.checkpoint.dir")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="siftmark-"))
    return _fallback[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing is at; it is deleted with the written tables."""
    path = f"{shared_dir(spark)}/siftmark-{uuid.uuid4().hex}/{name}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once below the shared folder and return a scan of what was written.

    Used where a table is read more than once and is dear to compute again (a pass through Python), or where a second
    computation might order rows otherwise (a sampled range partitioning). An empty ``df`` keeps its schema.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(keep: int = 0) -> None:
    """Delete the tables written so far, but for the first ``keep``; results that still read them must have been written or collected."""
    while len(_written) > keep:
        spark, path = _written.pop()
        try:
            jvm = spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone already
            pass


@contextmanager
def scope() -> Iterator[None]:
    """Tables written inside are deleted at its end: the place for a job whose results are written or collected inside."""
    keep = len(_written)
    try:
        yield
    finally:
        sweep(keep)


atexit.register(sweep)
