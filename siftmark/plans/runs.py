"""Runs of equal keys in a range-partitioned, externally sorted table.

Rows are range-partitioned and sorted on (key, id), so one key may spread over many partitions: a key that holds a third
of all rows is split like any other range. Each partition is scanned once; only its first and its last run can continue
elsewhere, so the stitching table has at most two rows a partition and is bounded by the partition count, not the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from siftmark.plans.workdir import materialize

_SCAN = T.StructType(
    [
        T.StructField("kind", T.IntegerType()),  # 0 a row, 1 a run that ends in this partition
        T.StructField("part", T.IntegerType()),
        T.StructField("id", T.LongType()),
        T.StructField("rep", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("edge", T.StringType()),  # the key, of the first and the last run of a partition only
        T.StructField("seq", T.LongType()),
    ]
)
_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("id", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("edge", pa.string()), ("seq", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over sorted (key, id) rows; carries only the run that is open, as key, first id and count."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    open_key: str | None = None
    open_rep, open_n, seq = 0, 0, 0

    def rows(kind: int, ids: pa.Array, reps: pa.Array, counts: pa.Array, edges: pa.Array, seqs: pa.Array) -> pa.RecordBatch:
        k = len(reps)
        full = lambda v, t: pa.repeat(pa.scalar(v, t), k)
        return pa.RecordBatch.from_arrays([full(kind, pa.int32()), full(part, pa.int32()), ids, reps, counts, edges, seqs], schema=_ARROW)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, ids = batch.column(0), batch.column(1)
        starts = [True] if open_key is None else [key[0].as_py() != open_key]
        change = pa.concat_arrays([pa.array(starts), pc.not_equal(key.slice(1), key.slice(0, n - 1))]) if n > 1 else pa.array(starts)
        at = pc.indices_nonzero(change).to_pylist()
        bounds = [*at, n]
        heads = ids.take(pa.array(at, pa.int64())).to_pylist() if at else []
        # rows before the first start continue the open run
        lead = bounds[0]
        reps: list[int] = [open_rep] * lead
        for i, head in enumerate(heads):
            reps.extend([head] * (bounds[i + 1] - bounds[i]))
        null = pa.nulls(n, pa.int64())
        yield rows(0, ids, pa.array(reps, pa.int64()), null, pa.nulls(n, pa.string()), null)
        open_n += lead
        if at:
            out_rep, out_n, out_edge, out_seq = [], [], [], []
            if open_key is not None:
                out_rep.append(open_rep), out_n.append(open_n), out_edge.append(open_key if seq == 0 else None), out_seq.append(seq)
                seq += 1
            for i in range(len(at) - 1):
                out_rep.append(heads[i]), out_n.append(bounds[i + 1] - bounds[i]), out_seq.append(seq)
                out_edge.append(key[at[i]].as_py() if seq == 0 else None)
                seq += 1
            open_key, open_rep, open_n = key[at[-1]].as_py(), heads[-1], n - at[-1]
            if out_rep:
                yield rows(1, pa.nulls(len(out_rep), pa.int64()), pa.array(out_rep, pa.int64()), pa.array(out_n, pa.int64()), pa.array(out_edge, pa.string()), pa.array(out_seq, pa.int64()))
    if open_key is not None:
        yield rows(1, pa.nulls(1, pa.int64()), pa.array([open_rep], pa.int64()), pa.array([open_n], pa.int64()), pa.array([open_key], pa.string()), pa.array([seq], pa.int64()))


def sorted_runs(df: DataFrame, key: str, id_col: str, partitions: int | None = None, written: bool = False) -> tuple[DataFrame, DataFrame]:
    """Group the rows of ``df`` by the non-null string ``key`` through an external sort.

    Returns ``members(id, rep)``, one row per row of ``df``, and ``runs(rep, n)``, one row per distinct key; ``rep`` is the
    smallest id of the key. ``id_col`` must be a bigint, unique in ``df``. Ties can't occur, as ids are unique; a null key is
    dropped (it is no key); an empty ``df`` gives two empty tables. The keys are written first, as sampling the ranges would
    make them twice; ``written`` says that ``df`` is a scan already.
    """
    src = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(id_col).cast("bigint").alias("id"))
    src = src if written else materialize(src, "sort_keys")
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # sorting on a hash first makes comparisons cheap and ranges even; the full key follows, so equal hashes don't merge keys
    ranged = src.withColumn("h", F.xxhash64("key")).repartitionByRange(n, "h", "key", "id").sortWithinPartitions("h", "key", "id")
    scan = materialize(ranged.select("key", "id").mapInArrow(_scan, _SCAN), "runs", "kind")
    edges = scan.where("kind = 1 and edge is not null")
    order = W.orderBy("part", "seq")  # at most two rows a partition
    island = F.sum((~F.col("edge").eqNullSafe(F.lag("edge").over(order))).cast("int")).over(order)
    stitched = edges.withColumn("island", island)
    per = W.partitionBy("island")
    fixed = stitched.select("part", F.col("rep").alias("was"), F.min("rep").over(per).alias("now"), F.sum("n").over(per).alias("total"))
    fixed = F.broadcast(fixed)
    members = scan.where("kind = 0").select("part", "id", "rep").join(fixed, (F.col("rep") == F.col("was")) & (scan["part"] == fixed["part"]), "left").select("id", F.coalesce("now", "rep").alias("rep"))
    runs = scan.where("kind = 1").select("part", "rep", "n").join(fixed, (F.col("rep") == F.col("was")) & (scan["part"] == fixed["part"]), "left").where("now is null or now = rep").select("rep", F.coalesce("total", "n").alias("n"))
    return members, runs


def _shared_scan(keys: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass over rows sorted by (keys, id): kind 0 a row whose key another id of this partition holds, kind 1 the ids of the
    partition's first or last key, kind 2 a row of such a key that no other id of this partition holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []  # rows of the open key while it has one id: of one record, so bounded by it
        open_key: tuple | None = None
        open_lo, open_hi, at_first = 0, 0, True

        def out(kind: int, rows: pa.RecordBatch, hi: pa.Array | None = None) -> pa.RecordBatch:
            cols = [pa.array(np.full(rows.num_rows, kind, np.int32)), hi or pa.nulls(rows.num_rows, pa.int64()), *rows.columns]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        def edge(key: tuple, lo: int, hi: int) -> pa.RecordBatch:
            rest = [pa.nulls(1, f.type) for f in list(schema)[3 + keys :]]
            return out(1, pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([lo], pa.int64()), *rest], names=schema.names[2:]), pa.array([hi], pa.int64()))

        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([*pending, b]).combine_chunks().to_batches()[0] if pending else b
            pending = []
            k = [rows.column(i).to_numpy() for i in range(keys)]
            ids = rows.column(keys).to_numpy()
            start = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in k])]))
            end = np.append(start[1:], len(ids))
            lo, hi = ids[start].copy(), ids[end - 1].copy()
            key_at = lambda g: tuple(int(c[start[g]]) for c in k)  # noqa: E731, B023
            if open_key is not None:
                if key_at(0) == open_key:
                    lo[0] = open_lo
                else:  # the open key ended with the batch before; its rows, of several ids, are out
                    if at_first:
                        yield edge(open_key, open_lo, open_hi)
                    at_first = False
            last = len(start) - 1
            shared = lo != hi
            flag = np.repeat(shared, end - start)
            if at_first and last > 0:
                yield edge(key_at(0), int(lo[0]), int(hi[0]))
                if not shared[0]:
                    yield out(2, rows.slice(0, int(end[0])))
                at_first = False
            if not shared[last]:
                pending = [rows.slice(int(start[last]))]
            if flag.any():
                yield out(0, rows.filter(pa.array(flag)))
            open_key, open_lo, open_hi = key_at(last), int(lo[last]), int(hi[last])
        if open_key is not None:
            yield edge(open_key, open_lo, open_hi)
            for p in pending:
                yield out(2, p)

    return run


def shared_rows(df: DataFrame, keys: list[str], id_col: str, name: str = "shared", partitions: int | None = None) -> DataFrame:
    """The rows of ``df`` whose ``keys`` (bigints) are also those of a row with another ``id_col`` (a bigint).

    Rows are range-partitioned and sorted on (keys, id), so a key that holds a third of all rows is split like any other range
    and no join is needed to tell its rows; only the first and the last key of a partition are looked up in a table of at most
    two rows a partition. ``df`` is written first, as the ranges are sampled from it. Repeated rows stay; none has a null.
    """
    src = materialize(df.select(*keys, id_col, *(c for c in df.columns if c not in (*keys, id_col))), name)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = [T.StructField("kind", T.IntegerType()), T.StructField("__hi", T.LongType()), *src.schema.fields]
    arrow = to_arrow_schema(T.StructType(fields))
    ordered = src.repartitionByRange(n, *keys, id_col).sortWithinPartitions(*keys, id_col)
    scan = materialize(ordered.mapInArrow(_shared_scan(len(keys), arrow), T.StructType(fields)), f"{name}_scan", "kind")
    edges = scan.where("kind = 1").groupBy(*keys).agg(F.min(id_col).alias("__lo"), F.max("__hi").alias("__top")).where("__lo <> __top").select(*keys)
    sure, open_rows = (scan.where(F.col("kind") == k).select(*src.columns) for k in (0, 2))
    return sure.unionByName(open_rows.join(F.broadcast(edges), keys).select(*src.columns))
