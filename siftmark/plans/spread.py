"""Work for all cores where a table comes in few pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that a kernel in a Python worker takes at once; bounds memory, not results.
SLICE_BYTES = 1 << 22


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most SLICE_BYTES of the text column, or one row."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield batch.slice(at, end - at)
        at = end


_PLAIN = {"Project", "Filter", "FileScan", "Scan", "LocalTableScan", "ColumnarToRow", "Union", "Range"}


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it is a plain scan with at most half as many; else ``df`` itself.

    A small compressed file is one partition, and one core would then do all tokenising. A table of many files has more
    partitions than a cluster has cores, so nothing is shuffled there. Only narrow plans are looked at: counting the partitions
    of any other would run it. Rows and columns are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().sparkPlan().toString()
    if not set(re.findall(r"^[\s:|+\-]*(?:\*\(\d+\) )?(\w+)", plan, re.M)) <= _PLAIN:
        return df
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
