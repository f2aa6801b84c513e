"""The checks of :mod:`siftmark.safety` as columns, for tables: true where a value is what the engine takes. Null is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.safety import LIMITS

ColumnLike = Column | str


def _c(v: ColumnLike) -> Column:
    return F.col(v) if isinstance(v, str) else v


def _sure(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def digest(v: ColumnLike) -> Column:
    return _sure(_c(v).rlike("\\A[0-9a-f]{64}\\z"))


def reference(v: ColumnLike) -> Column:
    return _sure(_c(v).rlike("\\A[0-9A-Za-z._-]{1,128}\\z"))


def label(v: ColumnLike) -> Column:
    return _sure(_c(v).rlike("\\A[^\\r\\n\\x00]{1,256}\\z"))


def finite(v: ColumnLike) -> Column:
    return _sure(~F.isnan(_c(v)) & (F.abs(_c(v)) != float("inf")))


def between(v: ColumnLike, low: int, high: int) -> Column:
    return _sure(_c(v).between(low, high))


def bucket_count(v: ColumnLike) -> Column:
    return between(v, 2, LIMITS["buckets"])


def ngram_size(v: ColumnLike) -> Column:
    return between(v, 1, LIMITS["ngram"])


def index(v: ColumnLike, limit: int) -> Column:
    return between(v, 0, limit - 1)


def count(v: ColumnLike, limit: int) -> Column:
    return between(v, 0, limit)


def capacity(cells: ColumnLike, limit: int = LIMITS["cells"]) -> Column:
    return between(cells, 0, limit)


def secret_free(meta: ColumnLike) -> Column:
    """A map without the values of keys that name secrets."""
    named = lambda k: k.rlike("(?i)(token|secret|password|passwd|api_?key|credential)") & (k != "token")
    return F.transform_values(_c(meta), lambda k, v: F.when(named(k), F.lit("[redacted]")).otherwise(v))


def failures(df: DataFrame, **tests: Column) -> DataFrame:
    """``check, rows, failed`` for each named test over all rows."""
    sums = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(~t).alias(n) for n, t in tests.items()))
    return sums.select("rows", F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("failed")) for n in tests))).alias("c")).select("c.check", "rows", "c.failed")
