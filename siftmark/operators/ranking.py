"""Ranks, review budgets, fusion and deterministic sampling. Global orders use :mod:`siftmark.plans.ranks`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftmark.functions.stats import budget_count, hash_order
from siftmark.plans.ranks import ranked, running


#: Rows up to which the first ones are a top-k, which Spark merges in one task; more are ranked over all partitions. Same rows either way.
TOP_K = 10_000


def first_rows(df: DataFrame, count: int, *order: Column) -> DataFrame:
    """The ``count`` first rows of ``df`` in a total order; all rows where there are fewer."""
    if count <= TOP_K:
        return df.orderBy(*order).limit(max(0, count))
    return ranked(df, *order, name="__rn").where(F.col("__rn") <= count).drop("__rn")


def average_ranks(df: DataFrame, value: str = "score") -> DataFrame:
    """``df`` with ``avg_rank``: 1-based, tied rows share the mean of their places. Ranks are made per distinct value."""
    sizes = df.groupBy(value).agg(F.count(F.lit(1)).alias("k"))
    placed = running(sizes, F.col(value), sums={"upto": "k"})
    ranks = placed.select(F.col(value).alias("v"), (F.col("upto") - (F.col("k") - 1) / 2).alias("avg_rank"))
    return df.join(ranks, df[value].eqNullSafe(F.col("v"))).drop("v")


def roc_auc(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """``auc`` from average ranks; 0.5 without a positive or a negative. Rows are combined to distinct scores first."""
    sizes = df.groupBy(score).agg(F.count(F.lit(1)).alias("k"), F.sum(y).alias("pos"))
    placed = running(sizes, F.col(score), sums={"upto": "k"})
    rank_sum = F.sum(F.col("pos") * (F.col("upto") - (F.col("k") - 1) / 2))
    s = placed.agg(F.sum("k").alias("n"), F.sum("pos").alias("p"), rank_sum.alias("r"))
    neg = F.col("n") - F.col("p")
    return s.select(F.coalesce(F.when((F.col("p") > 0) & (neg > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg)), F.lit(0.5)).alias("auc"))


def average_precision(df: DataFrame, score: str = "score", y: str = "y", tie: str = "row_idx") -> DataFrame:
    """``ap``: mean precision at the hits, ties by position; 0 without a positive."""
    placed = running(df.select(score, y, tie), F.col(score).desc(), F.col(tie), sums={"hits": y})
    s = placed.agg(F.sum(F.when(F.col(y) == 1, F.col("hits") / F.col("rn"))).alias("s"), F.sum(y).alias("p"))
    return s.select(F.coalesce(F.when(F.col("p") > 0, F.col("s") / F.col("p")), F.lit(0.0)).alias("ap"))


def top_budget(df: DataFrame, budget: float, score: str = "score", tie: str = "row_idx", least: int = 1) -> DataFrame:
    """The rows with the highest scores within a share of all rows, ties by position. Only the ranks' own order is sorted."""
    placed = ranked(df, F.col(score).desc(), F.col(tie))
    size = df.agg(F.count(F.lit(1)).alias("__n"))
    return placed.crossJoin(F.broadcast(size)).where(F.col("rn") <= budget_count("__n", F.lit(budget), least)).drop("__n")


def detection_at_budget(df: DataFrame, budget: float, score: str = "score", y: str = "y") -> DataFrame:
    """``flagged, hits, recall, precision`` of the rows within the budget."""
    top = top_budget(df, budget, score).agg(F.count(F.lit(1)).alias("flagged"), F.coalesce(F.sum(y), F.lit(0)).alias("hits"))
    whole = df.agg(F.coalesce(F.sum(y), F.lit(0)).alias("p"))
    recall = F.when(F.col("p") > 0, F.col("hits") / F.col("p")).otherwise(0.0)
    precision = F.when(F.col("flagged") > 0, F.col("hits") / F.col("flagged")).otherwise(0.0)
    return top.crossJoin(whole).select("flagged", "hits", F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision"))


def flag_uids(df: DataFrame, budget: float) -> DataFrame:
    """Rows within the budget that have a score above 0."""
    return top_budget(df, budget).where("score > 0").select("row_idx")


def sanitize(df: DataFrame, scores: DataFrame, budget: float) -> tuple[DataFrame, DataFrame]:
    """``(kept, removed)``: exactly the budget's number of rows (it may be 0) is removed, highest scores first, ties by position."""
    scored = df.select("row_idx").join(scores.select("row_idx", "score"), "row_idx", "left").fillna({"score": 0.0})
    removed = top_budget(scored, budget, least=0).select("row_idx")
    return df.join(removed, "row_idx", "left_anti"), removed


def removal_report(df: DataFrame, removed: DataFrame) -> DataFrame:
    """``removed, poisoned_removed, recall, collateral`` of a removal against the ground truth."""
    hit = df.join(removed.withColumn("gone", F.lit(1)), "row_idx", "left").select((F.col("origin") == "poisoned").cast("int").alias("bad"), F.coalesce("gone", F.lit(0)).alias("gone"))
    s = hit.agg(F.sum("gone").alias("removed"), F.sum(F.col("gone") * F.col("bad")).alias("poisoned_removed"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n"))
    clean_gone, clean = F.col("removed") - F.col("poisoned_removed"), F.col("n") - F.col("bad")
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return s.select("removed", "poisoned_removed", share(F.col("poisoned_removed"), F.col("bad")).alias("recall"), share(clean_gone, clean).alias("collateral"))


def finite(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``score`` with null, NaN and infinite values as 0, and ``replaced`` to tell them."""
    bad = F.col(raw).isNull() | F.isnan(raw) | (F.abs(raw) == float("inf"))
    return df.withColumn("score", F.when(bad, 0.0).otherwise(F.col(raw))).withColumn("replaced", bad)


def minmax(df: DataFrame, score: str = "score", constant: float = 0.0) -> DataFrame:
    """``df`` with ``score`` scaled to 0..1; ``constant`` where all are the same."""
    s = df.agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    spread = F.col("__hi") - F.col("__lo")
    scaled = F.when(spread > 1e-12, (F.col(score) - F.col("__lo")) / spread).otherwise(constant)
    return df.crossJoin(F.broadcast(s)).withColumn(score, scaled).drop("__lo", "__hi")


def zscores(df: DataFrame, value: str, out: str = "z") -> DataFrame:
    """Sample z-scores; 0 for fewer than two rows or no spread."""
    s = df.agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    z = F.when(F.col("__s") > 1e-12, (F.col(value) - F.col("__m")) / F.col("__s")).otherwise(0.0)
    return df.crossJoin(F.broadcast(s)).withColumn(out, z).drop("__m", "__s")


def rank_fuse(scores: DataFrame, top: int = 2) -> DataFrame:
    """``row_idx, score``: the mean of the ``top`` largest fractional ranks a record has over the detectors that tell rows apart.

    ``scores(detector, row_idx, score)`` is long. A rank is the place by (score, position) over n - 1. One range partitioning on
    (detector, score, position) ranks all detectors at once; silent detectors are left out.
    """
    spread = scores.groupBy("detector").agg((F.max("score") - F.min("score")).alias("spread"), F.count(F.lit(1)).alias("n"))
    loud = spread.where("spread > 1e-12").select("detector", "n")
    first = W.orderBy("detector").rowsBetween(W.unboundedPreceding, -1)  # one row a detector
    base = loud.withColumn("base", F.coalesce(F.sum("n").over(first), F.lit(0)))
    placed = ranked(scores.join(F.broadcast(loud.select("detector")), "detector"), F.col("detector"), F.col("score"), F.col("row_idx"))
    frac = F.when(F.col("n") > 1, (F.col("rn") - F.col("base") - 1) / (F.col("n") - 1)).otherwise(0.0)
    ranks = placed.join(F.broadcast(base), "detector").select("row_idx", frac.alias("r"))
    best = ranks.groupBy("row_idx").agg(F.slice(F.sort_array(F.collect_list("r"), asc=False), 1, top).alias("b"))  # one per detector
    fused = best.select("row_idx", (F.aggregate("b", F.lit(0.0), lambda a, x: a + x) / F.size("b")).alias("score"))
    rows = scores.select("row_idx").distinct()
    return rows.join(fused, "row_idx", "left").select("row_idx", F.coalesce("score", F.lit(0.0)).alias("score"))


def leaders(scores: DataFrame, order: list[str]) -> DataFrame:
    """``row_idx, detector, score``: each record's best detector, the first in ``order`` on ties."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("detector"))
    best = scores.groupBy("row_idx").agg(F.max(F.struct(F.col("score"), (-place).alias("o"), F.col("detector"))).alias("b"))
    return best.select("row_idx", "b.detector", "b.score")


# --- deterministic sampling -------------------------------------------------------------------------------------------


def shuffled(df: DataFrame, seed: int, namespace: str = "shuffle", key: str = "uid") -> DataFrame:
    """``df`` with ``rn``, its place in a seeded shuffle."""
    return ranked(df.withColumn("__h", hash_order(seed, namespace, key)), F.col("__h"), F.col(key)).drop("__h")


def sample(df: DataFrame, count: int, seed: int, namespace: str = "sample", key: str = "uid") -> DataFrame:
    """``count`` rows without replacement: the first ones in a seeded order."""
    return first_rows(df.withColumn("__h", hash_order(seed, namespace, key)), count, F.col("__h"), F.col(key)).drop("__h")


def folds(df: DataFrame, k: int, seed: int) -> DataFrame:
    """``df`` with ``fold``: a round robin over a seeded shuffle, so folds differ by one row at most."""
    return shuffled(df, seed, "folds").withColumn("fold", ((F.col("rn") - 1) % max(2, k)).cast("int")).drop("rn")


def stratified_split(df: DataFrame, fractions: tuple[float, float, float] = (0.7, 0.1, 0.2), seed: int = 0) -> DataFrame:
    """``df`` with ``part``: per label, rounded shares of a seeded shuffle go to train and validation, the rest to test.

    A label may hold most rows, so places within labels come from one global range partitioning on (label, draw).
    """
    total = sum(fractions)
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("label").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row a label
    placed = ranked(df.withColumn("__h", hash_order(seed, "split", "uid")), F.col("label"), F.col("__h"), F.col("uid"))
    place = F.col("rn") - F.col("base")
    train, val = (F.rint(F.col("n") * F.lit(f / total)) for f in fractions[:2])
    part = F.when(place <= train, "train").when(place <= train + val, "validation").otherwise("test")
    return placed.join(F.broadcast(base), "label").withColumn("part", part).drop("rn", "n", "base", "__h")


def _group_places(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``place``, 1-based within its ``grp``; groups may be of any size."""
    counts = df.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    base = running(counts, F.col("grp"), name="g", sums={"upto": "n"}).select("grp", (F.col("upto") - F.col("n")).alias("base"))
    return ranked(df, F.col("grp"), *order).join(base, "grp").withColumn("place", F.col("rn") - F.col("base")).drop("rn", "base")


def cover(df: DataFrame, count: int, seed: int) -> DataFrame:
    """``count`` rows taken round robin over the groups ``grp``, in a seeded order within each."""
    placed = _group_places(df.withColumn("__h", hash_order(seed, "cover", "uid")), F.col("__h"), F.col("uid"))
    return first_rows(placed, count, F.col("place"), F.col("grp")).drop("place", "__h")


def gain(df: DataFrame, count: int, quota: float = 1.0) -> DataFrame:
    """``count`` rows by ``gain``, at most a quota a group ``grp`` at first, then the best of the others."""
    groups = df.agg(F.countDistinct("grp").alias("__g"))
    placed = _group_places(df, F.col("gain").desc(), F.col("row_idx"))
    limit = F.greatest(F.lit(1.0), F.rint(F.lit(quota * count) / F.greatest(F.lit(1), F.col("__g"))))
    within = placed.crossJoin(F.broadcast(groups)).withColumn("__late", F.col("place") > limit)
    return first_rows(within, count, F.col("__late"), F.col("gain").desc(), F.col("row_idx")).drop("place", "__g", "__late")
