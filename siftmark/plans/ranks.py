"""Global ranks and running sums without sending all rows through one task.

A window without partitions sorts the whole table in one task. Here rows are range-partitioned by the order, each partition
counts its own, and the partitions' offsets, one row each, are broadcast back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftmark.plans.workdir import materialize

_INDEX = (1 << 33) - 1  # monotonically_increasing_id: partition above, position below


def ranked(df: DataFrame, *order: Column, name: str = "rn") -> DataFrame:
    """``df`` with ``name``: 1-based row numbers in the given order. The order must be total for a defined result."""
    return running(df, *order, name=name)


def running(df: DataFrame, *order: Column, name: str = "rn", sums: dict[str, str] | None = None) -> DataFrame:
    """Row numbers, and for each (new column, column) of ``sums`` the sum over all rows up to and with the current one."""
    sums = sums or {}
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mono = F.monotonically_increasing_id()
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__m", mono)
    placed = materialize(placed.withColumn("__p", F.shiftright("__m", 33)).withColumn("__i", F.col("__m").bitwiseAND(_INDEX)).drop("__m"), "ranks")
    totals = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), *(F.sum(c).alias(f"__s_{new}") for new, c in sums.items()))
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    offsets = totals.select("__p", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__o{c}") for c in totals.columns if c != "__p"))
    out = placed.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__o__n") + F.col("__i") + 1)
    inside = W.partitionBy("__p").orderBy("__i").rowsBetween(W.unboundedPreceding, 0)
    for new, c in sums.items():
        out = out.withColumn(new, F.sum(c).over(inside) + F.col(f"__o__s_{new}"))
    return out.drop(*(c for c in out.columns if c.startswith("__")))
