"""Joins of many rows with a table of one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame

from siftmark.plans.workdir import materialize


def join_keyed(rows: DataFrame, keyed: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, an aggregate with one row per key.

    An aggregate between a shuffle and a join keeps adaptive execution from splitting a key that very many rows have. ``keyed`` is
    written first, so both inputs of the join are plain shuffles of scans and the partition of a hot key is split; its size is
    known too, so a small one is broadcast by Spark's own threshold.
    """
    return rows.join(materialize(keyed, "keyed"), on, how)
