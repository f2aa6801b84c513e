"""Audit without ground truth: a review queue, a carrier shortlist and a permutation test of how concentrated contradictions are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.functions.hashing import splitmix64
from siftmark.functions.stats import Z95, wilson_lower
from siftmark.operators import detectors as D
from siftmark.operators import grams as G
from siftmark.operators.models import out_of_fold
from siftmark.operators.ranking import leaders
from siftmark.plans.keyed import join_keyed
from siftmark.plans.ranks import ranked
from siftmark.plans.workdir import materialize

MAX_QUEUE, MAX_PERMUTATIONS = 5000, 20_000


def review_queue(fused: DataFrame, scores: DataFrame, df: DataFrame, budget: float, order: list[str]) -> DataFrame:
    """``queue_rank, row_idx, score, detector, label, excerpt``: the records to look at first, at least one and at most MAX_QUEUE."""
    k = max(1, min(MAX_QUEUE, int(round(df.count() * budget))))
    top = fused.orderBy(F.desc("score"), "row_idx").limit(k)  # a top-k: no global sort
    lead = leaders(scores.join(F.broadcast(top.select("row_idx")), "row_idx"), order).select("row_idx", "detector")
    rows = top.join(lead, "row_idx").join(df.select("row_idx", "label", F.left("text", F.lit(140)).alias("excerpt")), "row_idx")
    packed = rows.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "row_idx", "detector", "label", "excerpt"))).alias("q"))
    return packed.select(F.posexplode("q").alias("p", "e")).select((F.col("p") + 1).alias("queue_rank"), "e.row_idx", (-F.col("e.s")).alias("score"), "e.detector", "e.label", "e.excerpt")


def concentration_statistic(df: DataFrame, max_n: int = 2, min_count: int = 4) -> DataFrame:
    """``gram, statistic, gram_count, hits``: the n-gram whose squared Wilson bound times flagged occurrences is largest; ``df`` has flag."""
    st = G.gram_stats(df, F.col("flag"), max_n, min_count).where("target_count > 0")
    score = F.round(F.pow(wilson_lower("target_count", "gram_count"), F.lit(2.0)) * F.col("target_count"), 6)
    return st.select("gram", score.alias("statistic"), "gram_count", F.col("target_count").alias("hits"), "n").orderBy(F.desc("statistic"), "n", "gram").limit(1).drop("n")


def shuffled_places(place: np.ndarray, size: int, keys: np.ndarray) -> np.ndarray:
    """Each place (0 .. size - 1) under each permutation: rows by places, columns by keys.

    A permutation is a keyed Feistel network of four rounds on the next power of four, walked until it is back inside; so every
    place has one image, whoever computes it, and nothing has to be sorted or stored.
    """
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    x = np.repeat(place.astype(np.uint64)[:, None], len(keys), axis=1)
    key = np.repeat(keys.astype(np.uint64)[None, :], len(place), axis=0)
    todo = np.ones(x.shape, bool)
    while todo.any():
        y, k = x[todo], key[todo]
        left, right = y >> shift, y & low
        for r in range(4):
            left, right = right, left ^ (splitmix64(right + (k << np.uint64(2)) + np.uint64(r)) & low)
        x[todo] = left << shift | right
        todo &= x >= size
    return x.astype(np.int64)


def _flagged_hits(permutations: int, seed: int, size: int, flags: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per gram, its occurrences in flagged records under each permutation, added up in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = splitmix64(np.arange(permutations, dtype=np.uint64) + (np.uint64(seed & 0xFFFFFFFF) << np.uint64(20)))
        acc: dict[str, np.ndarray] = {}
        total: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            g = list(acc)
            flat = np.concatenate([acc[x] for x in g]) if g else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, permutations, dtype=np.int32)), pa.array(flat))
            out = pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array([total[x] for x in g], pa.int64()), lists], names=["gram", "gram_count", "hits"])
            acc.clear(), total.clear()
            return out

        for b in batches:
            places, row = np.unique(b.column(2).to_numpy(), return_inverse=True)
            flagged = shuffled_places(places, size, keys) < flags
            tf = b.column(3).to_numpy()
            grams = b.column(0).dictionary_encode()
            code = grams.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0])) if len(code) else order
            names, counts = grams.dictionary.to_pylist(), b.column(1).to_numpy()
            for i, at in enumerate(first):  # one sum a gram of the batch
                part = order[at : first[i + 1] if i + 1 < len(first) else None]
                g = names[code[part[0]]]
                hits = tf[part] @ flagged[row[part]]
                if g in acc:
                    acc[g] += hits
                else:
                    if len(acc) * permutations > 1 << 22:
                        yield flush()
                    acc[g], total[g] = hits.astype(np.int64), int(counts[part[0]])
        yield flush()

    return run


def _largest(permutations: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows sorted by gram: adds up each gram's counts and keeps the largest statistic of each permutation, one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(permutations)
        open_gram, hits, n = None, np.zeros(permutations, np.int64), 0

        def close() -> None:
            if n:
                p, zz = hits / n, Z95 * Z95
                low = np.maximum(0.0, (p + zz / (2 * n) - Z95 * np.sqrt((p * (1 - p) + zz / (4 * n)) / n)) / (1 + zz / n))
                np.maximum(best, low * low * hits, out=best)

        for b in batches:
            rows = b.column(2).flatten().to_numpy().reshape(-1, permutations)
            for g, count, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), rows, strict=True):
                if g != open_gram:
                    close()
                    open_gram, hits, n = g, np.zeros(permutations, np.int64), count
                hits = hits + h
        close()
        yield pa.RecordBatch.from_arrays([pa.array([best.tolist()], pa.list_(pa.float64()))], names=["best"])

    return run


def concentration_test(df: DataFrame, permutations: int = 200, seed: int = 0, max_n: int = 2, min_count: int = 4) -> DataFrame:
    """``statistic, permutations, null_mean, null_max, p_value`` for ``df`` with flag (0/1).

    Every permutation flags exactly as many records as are flagged, by a keyed permutation of their places. Counts of all
    permutations are added up per gram within a task and again after one shuffle, as one array a gram, so all of them cost one pass.
    """
    permutations = max(0, min(MAX_PERMUTATIONS, permutations))
    observed = concentration_statistic(df, max_n, min_count).select("statistic")
    s = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("flag"), F.lit(0)).alias("k")).first()
    if not permutations or not s["n"]:
        return observed.select("statistic", F.lit(permutations if s["n"] else 0).cast("bigint").alias("permutations"), F.lit(None).cast("double").alias("null_mean"), F.lit(None).cast("double").alias("null_max"), F.lit(1.0).alias("p_value"))
    placed = ranked(df.select("row_idx", "text"), F.col("row_idx"), name="place").select((F.col("place") - 1).alias("row_idx"), "text")
    per_doc = G.featurize(placed, max_n)
    totals = per_doc.groupBy("gram").agg(F.sum("tf").alias("gram_count")).where(F.col("gram_count") >= min_count)
    postings = join_keyed(per_doc, totals, "gram").select("gram", "gram_count", "row_idx", "tf")
    part = postings.mapInArrow(_flagged_hits(permutations, seed, s["n"], int(s["k"])), "gram string, gram_count bigint, hits array<bigint>")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = part.repartition(tasks, "gram").sortWithinPartitions("gram").mapInArrow(_largest(permutations), "best array<double>")
    null = best.select(F.posexplode("best").alias("p", "t")).groupBy("p").agg(F.max("t").alias("t"))  # permutations rows a task
    joined = null.crossJoin(F.broadcast(observed))
    beyond = F.sum((F.round("t", 6) >= F.col("statistic")).cast("int"))
    return joined.groupBy("statistic").agg(F.count(F.lit(1)).alias("permutations"), F.round(F.avg("t"), 6).alias("null_mean"), F.round(F.max("t"), 6).alias("null_max"), beyond.alias("b")).select("statistic", "permutations", "null_mean", "null_max", F.round((1 + F.col("b")) / (1 + F.col("permutations")), 6).alias("p_value"))


def carriers(df: DataFrame, c: D.Context, names: list[str], predictions: DataFrame) -> DataFrame:
    """``detector, gram, score``: the evidence of the named detectors in their order, at most ``top_k`` n-grams; the first detector keeps one."""
    parts = df.sparkSession.createDataFrame([], "ord int, detector string, gram string, n int, score double")
    for i, name in enumerate(names):
        found = D.evidence(df, name, c, predictions)
        if found is not None:
            parts = parts.unionByName(found.select(F.lit(i).alias("ord"), F.lit(name).alias("detector"), "gram", "n", "score"))
    first = parts.where("gram <> ''").groupBy("gram").agg(F.min(F.struct("ord", (-F.col("score")).alias("s"), "n", "detector")).alias("b"))
    return first.orderBy("b.ord", "b.s", "b.n", "gram").limit(c.top_k).select("b.detector", "gram", (-F.col("b.s")).alias("score"))


def audit(df: DataFrame, c: D.Context = D.Context(), names: list[str] | None = None, permutations: int = 200) -> dict[str, DataFrame]:
    """``queue``, ``carriers`` and ``test`` of a corpus without ground truth."""
    names = names or list(D.REGISTRY)
    predictions = materialize(out_of_fold(df, c.folds, c.seed), "oof")
    scores, fused = D.run_suite(df, c, names, predictions)
    flagged = df.join(predictions, "row_idx", "left").withColumn("flag", (F.coalesce("pred", "label") != F.col("label")).cast("int"))
    return {"queue": review_queue(fused, scores, df, c.budget, names), "carriers": carriers(df, c, names, predictions), "test": concentration_test(flagged, permutations, c.seed)}
