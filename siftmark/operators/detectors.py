"""Detectors: each gives every record a score in 0..1 and never reads ``origin`` or ``attack``."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftmark.functions.hashing import minhash
from siftmark.functions.stats import wilson_lower
from siftmark.functions.text import tokens
from siftmark.functions.unicode import describe
from siftmark.operators import grams as G
from siftmark.operators.models import featurize, losses, out_of_fold
from siftmark.operators.ranking import finite, minmax, rank_fuse, zscores
from siftmark.plans.keyed import join_keyed
from siftmark.plans.spread import spread
from siftmark.plans.workdir import materialize


@dataclass(frozen=True)
class Context:
    target: str | None = None
    seed: int = 0
    budget: float = 0.05
    max_n: int = 2
    min_count: int = 4
    top_k: int = 12
    folds: int = 3

    @property
    def shortlist(self) -> int:
        return max(4 * self.top_k, 40)


def _top_per_label(carriers: DataFrame, k: int) -> DataFrame:
    """The ``k`` best carriers of each label, ties by size and gram; each task keeps its ``k`` best before they are shuffled."""
    place = F.row_number().over(W.partitionBy("label").orderBy(F.desc("score"), "n", "gram"))
    return carriers.withColumn("place", place).where(F.col("place") <= k).select("label", "gram", "n", "score")


def gram_purity(df: DataFrame, c: Context = Context()) -> DataFrame:
    """Records that hold an n-gram with nearly one label only."""
    carriers = G.purity_carriers(df, c.max_n, c.min_count, target=c.target)
    return minmax(G.record_scores(df, _top_per_label(carriers, c.shortlist), c.max_n))


def contradiction_carriers(df: DataFrame, predictions: DataFrame, c: Context = Context()) -> DataFrame:
    """``gram, n, gram_count, hits, score``: n-grams of records whose label a model that hasn't seen them contradicts."""
    flagged = df.join(predictions, "row_idx", "left").withColumn("flag", (F.coalesce("pred", "label") != F.col("label")).cast("int"))
    prior = flagged.agg(F.avg("flag").alias("prior"))
    stats = G.gram_stats(flagged, F.col("flag"), c.max_n, c.min_count).crossJoin(F.broadcast(prior))
    score = F.round(F.pow(wilson_lower("target_count", "gram_count"), F.lit(2.0)) * F.col("target_count"), 6)
    return stats.where(F.col("target_count") / F.col("gram_count") > F.col("prior")).select("gram", "n", "gram_count", F.col("target_count").alias("hits"), score.alias("score")).where("score > 0")


def contradiction(df: DataFrame, c: Context = Context(), predictions: DataFrame | None = None, weight: float = 0.5) -> DataFrame:
    """Contradicted records, and records that share n-grams with them. ``predictions`` default to an out-of-fold linear model."""
    predictions = materialize(out_of_fold(df, c.folds, c.seed), "oof") if predictions is None else predictions
    carriers = contradiction_carriers(df, predictions, c).orderBy(F.desc("score"), "n", "gram").limit(c.shortlist)
    held = minmax(G.record_scores(df, carriers, c.max_n))
    flags = df.select("row_idx", "label").join(predictions, "row_idx", "left").select("row_idx", (F.coalesce("pred", "label") != F.col("label")).cast("double").alias("flag"))
    return minmax(held.join(flags, "row_idx").select("row_idx", ((1 - weight) * F.col("flag") + weight * F.col("score")).alias("score")))


def rarity_tokens(df: DataFrame) -> DataFrame:
    """``token, doc_count, value``: rare tokens whose records nearly all have one label; tokens of one record don't count."""
    per = G.token_label(df).groupBy("token").agg(F.sum("doc_count").alias("doc_count"), F.max("doc_count").alias("top"))
    n = df.agg(F.count(F.lit(1)).alias("docs"))
    value = F.log(F.col("docs") / F.col("doc_count")) * F.greatest(F.lit(0.0), F.col("top") / F.col("doc_count") - 0.5) * 2
    return per.where("doc_count >= 2").crossJoin(F.broadcast(n)).select("token", "doc_count", value.alias("value"))


def rarity_carriers(df: DataFrame) -> DataFrame:
    """``token, value``: the tokens that give a record its rarity score; the first by name where several do."""
    hits = join_keyed(G.distinct_tokens(df, "row_idx"), rarity_tokens(df).where("value > 0"), "token")
    best = hits.groupBy("row_idx").agg(F.min(F.struct((-F.col("value")).alias("v"), "token")).alias("b"))
    return best.select("b.token", (-F.col("b.v")).alias("value")).distinct()


def rarity(df: DataFrame, c: Context = Context()) -> DataFrame:
    hits = join_keyed(G.distinct_tokens(df, "row_idx"), rarity_tokens(df).where("value > 0"), "token").groupBy("row_idx").agg(F.max("value").alias("score"))
    return minmax(df.select("row_idx").join(hits, "row_idx", "left").fillna({"score": 0.0}))


def confusable_groups(described: DataFrame, ratio: float = 4.0) -> DataFrame:
    """``token, anchor, n, anchor_n``: rare tokens and the common token of the same skeleton. ``described`` has token, n, skeleton."""
    best = described.groupBy("skeleton").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("token"))).alias("a"))
    pair = described.join(best, "skeleton").select("token", F.col("a.token").alias("anchor"), "n", (-F.col("a.m")).alias("anchor_n"))
    return pair.where((F.col("token") != F.col("anchor")) & (F.col("anchor_n") >= ratio * F.col("n")))


def suspicious_tokens(df: DataFrame, ratio: float = 4.0) -> DataFrame:
    """``token, shown, skeleton, reason, n``: tokens with a risk, or that look like a more common token."""
    counts = G.doc_freq(df).select("token", F.col("doc_count").alias("n"))
    d = materialize(describe(counts), "described")
    alike = confusable_groups(d, ratio).join(d.select(F.col("token").alias("anchor"), F.col("skeleton").alias("as")), "anchor").select("token", F.concat(F.lit("confusable-with-"), F.left("as", F.lit(24))).alias("alike"))
    reason = F.coalesce(F.get("risks", F.lit(0)), F.col("alike"))
    return d.join(alike, "token", "left").withColumn("reason", reason).where(F.col("reason").isNotNull()).select("token", "shown", "skeleton", "reason", "n")


def confusable_carriers(df: DataFrame, ratio: float = 4.0) -> DataFrame:
    """``token, shown, w``: suspicious tokens with their weight."""
    n = df.agg(F.count(F.lit(1)).alias("docs"))
    weight = F.log10(F.col("docs") / F.col("n") + 1) * F.when(F.col("reason") == "unnormalised", 1.0).otherwise(2.0)
    return suspicious_tokens(df, ratio).crossJoin(F.broadcast(n)).select("token", "shown", weight.alias("w"))


def confusable(df: DataFrame, c: Context = Context(), ratio: float = 4.0) -> DataFrame:
    weights = confusable_carriers(df, ratio).select("token", "w")
    hits = join_keyed(G.distinct_tokens(df, "row_idx"), weights, "token").groupBy("row_idx").agg(F.max("w").alias("score"))
    return minmax(df.select("row_idx").join(hits, "row_idx", "left").fillna({"score": 0.0}))


def loss_dynamics(df: DataFrame, c: Context = Context()) -> DataFrame:
    """Learning curves: a high first loss and a fast fall."""
    t = materialize(losses(df), "losses").withColumn("drop", F.col("first") - F.col("last"))
    z = zscores(zscores(zscores(t, "first", "zf"), "drop", "zd"), "last", "zl")
    return minmax(z.select("row_idx", (0.4 * F.col("zf") + 0.4 * F.col("zd") - 0.2 * F.col("zl")).alias("score")))


# --- representation -----------------------------------------------------------------------------------------------------


def _vectors(df: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            vs = [featurize(t or [], 1, buckets, known) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v[0].astype(np.int32) for v in vs], pa.list_(pa.int32())), pa.array([v[1] for v in vs], pa.list_(pa.float64()))], names=["row_idx", "label", "idx", "val"])

    src = spread(df.select("row_idx", "label", "text")).select("row_idx", "label", tokens(F.col("text")).alias("toks"))
    return src.mapInArrow(run, "row_idx bigint, label string, idx array<int>, val array<double>")


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    idx, val = b.column("idx"), b.column("val")
    row = np.repeat(np.arange(b.num_rows), np.asarray(idx.value_lengths()))
    return row, idx.flatten().to_numpy(zero_copy_only=False), val.flatten().to_numpy(zero_copy_only=False)


def _sums(vectors: DataFrame, labels: list[str], buckets: int, directions: dict[str, np.ndarray] | None, means: dict[str, np.ndarray] | None) -> dict[str, np.ndarray]:
    """Per label, the sum of the vectors or, with directions, of projection times centred vector; buckets numbers per label.

    Each task adds up its rows to one array per label, so what comes back is bounded by tasks x labels x buckets bytes and is
    combined by the shuffle before the driver sees labels x buckets of it.
    """
    sent = vectors.sparkSession.sparkContext.broadcast((labels, directions, means))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, d, m = sent.value
        place = {x: i for i, x in enumerate(names)}
        acc = np.zeros((len(names), buckets))
        weight = np.zeros(len(names))
        for b in batches:
            at = np.array([place.get(x, -1) for x in b.column("label").to_pylist()])
            row, idx, val = _flat(b)
            w = np.ones(b.num_rows)
            if d is not None:
                dirs = np.stack([d[x] for x in names])
                w = np.bincount(row, dirs[at[row], idx] * val, b.num_rows) - np.array([float(m[x] @ d[x]) for x in names])[at]
            keep = at[row] >= 0
            np.add.at(acc, (at[row][keep], idx[keep]), (w[row] * val)[keep])
            np.add.at(weight, at[at >= 0], w[at >= 0])
        k, i = np.nonzero(acc)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, np.arange(len(names))).astype(np.int32)), pa.array(np.append(i, np.full(len(names), -1)).astype(np.int32)), pa.array(np.append(acc[k, i], weight))], names=["k", "i", "v"])

    out = {x: np.zeros(buckets + 1) for x in labels}
    for r in vectors.mapInArrow(run, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect():
        out[labels[r["k"]]][r["i"]] = r["v"]  # the last place (-1) has the sum of weights
    return out


def top_directions(vectors: DataFrame, labels: list[str], count: int, iterations: int, seed: int, buckets: int) -> tuple[dict, list[dict]]:
    """Means and leading directions of each label's centred vectors, by distributed power iteration with deflation."""
    s = _sums(vectors, labels, buckets, None, None)
    means = {x: v[:-1] / max(1.0, v[-1]) for x, v in s.items()}
    found: list[dict] = []
    for order in range(count):
        cur = {x: np.random.default_rng([seed, order, i]).standard_normal(buckets) * (means[x] != 0) for i, x in enumerate(labels)}
        for _ in range(iterations):
            s = _sums(vectors, labels, buckets, cur, means)
            for x in labels:
                v = s[x][:-1] - s[x][-1] * means[x]
                for d in found:
                    v = v - (v @ d[x]) * d[x]
                norm = np.sqrt(v @ v)
                if norm >= 1e-12:
                    cur[x] = v / norm
        found.append(cur)
    return means, found


def _projected(vectors: DataFrame, labels: list[str], means: dict, found: list[dict]) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast((means, found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, ds = sent.value
        for b in batches:
            names = b.column("label").to_pylist()
            row, idx, val = _flat(b)
            cols = []
            for d in ds:
                w = np.zeros(b.num_rows)
                for x in set(names):
                    hit = np.array([n == x for n in names])[row] if len(row) else np.zeros(0, bool)
                    w += np.bincount(row[hit], d[x][idx[hit]] * val[hit], b.num_rows)
                cols.append(w - np.array([float(m[x] @ d[x]) for x in names]))
            while len(cols) < 2:
                cols.append(np.zeros(b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column("row_idx"), b.column("label"), pa.array(cols[0]), pa.array(cols[1])], names=["row_idx", "label", "x", "y"])

    return vectors.where(F.col("label").isin(labels)).mapInArrow(run, "row_idx bigint, label string, x double, y double")


def _groups(df: DataFrame, c: Context, least: int) -> list[str]:
    sizes = df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return sorted(r["label"] for r in sizes.collect() if c.target in (None, r["label"]))


#: Numbers of one direction table that is sent to all tasks, 64 MB; more labels take several passes.
MAX_TABLE = 1 << 23


def _bounded(labels: list[str], buckets: int) -> list[list[str]]:
    size = max(1, MAX_TABLE // buckets)
    return [labels[i : i + size] for i in range(0, len(labels), size)]


def spectral(df: DataFrame, c: Context = Context(), buckets: int = 1 << 14, iterations: int = 10) -> DataFrame:
    """Squared projection on the leading direction of the label's records; 0 in labels of fewer than eight records."""
    labels = _groups(df, c, 8)
    if not labels:
        return df.select("row_idx", F.lit(0.0).alias("score"))
    vectors = materialize(_vectors(df, buckets), "vectors")
    hit = None
    for some in _bounded(labels, buckets):
        means, found = top_directions(vectors, some, 1, iterations, c.seed, buckets)
        part = _projected(vectors, some, means, found).select("row_idx", (F.col("x") * F.col("x")).alias("score"))
        hit = part if hit is None else hit.unionByName(part)
    return minmax(df.select("row_idx").join(hit, "row_idx", "left").fillna({"score": 0.0}))


def clustering(df: DataFrame, c: Context = Context(), buckets: int = 1 << 14, iterations: int = 8, rounds: int = 25) -> DataFrame:
    """Two clusters per label in the leading plane; members of the smaller one score higher. 0 in labels of fewer than sixteen."""
    labels = _groups(df, c, 16)
    if not labels:
        return df.select("row_idx", F.lit(0.0).alias("score"))
    vectors = materialize(_vectors(df, buckets), "vectors")
    points = None
    for some in _bounded(labels, buckets):
        means, found = top_directions(vectors, some, 2, iterations, c.seed, buckets)
        part = _projected(vectors, some, means, found)
        points = part if points is None else points.unionByName(part)
    points = materialize(points, "points")
    near = lambda q: F.min_by(F.struct("x", "y"), F.struct(F.abs(F.col("x") - F.col(q)), "row_idx"))
    ends = points.groupBy("label").agg(F.percentile_approx("x", 1 / 6).alias("lo"), F.percentile_approx("x", 5 / 6).alias("hi"))
    start = points.join(F.broadcast(ends), "label").groupBy("label").agg(near("lo").alias("a"), near("hi").alias("b")).collect()
    centres = {r["label"]: np.array([[r["a"]["x"], r["a"]["y"]], [r["b"]["x"], r["b"]["y"]]]) for r in start}
    for p in centres.values():
        if np.allclose(p[0], p[1], atol=0):
            p[1] += 1e-3
    spark = df.sparkSession
    for _ in range(rounds):
        placed = _placed(points, centres, spark)
        sums = placed.groupBy("label", "side").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).collect()
        new = {x: p.copy() for x, p in centres.items()}
        for r in sums:
            new[r["label"]][r["side"]] = (r["x"], r["y"])
        moved = max(float(np.abs(new[x] - centres[x]).max()) for x in centres)
        centres = new
        if moved <= 1e-9:
            break
    placed = _placed(points, centres, spark)
    sizes = placed.groupBy("label").agg(F.sum(1 - F.col("side")).alias("n0"), F.sum("side").alias("n1")).select("label", F.when(F.col("n0") <= F.col("n1"), 0).otherwise(1).alias("minor"))
    out = placed.join(F.broadcast(sizes), "label")
    d_minor, d_major = F.when(F.col("minor") == 0, F.col("d0")).otherwise(F.col("d1")), F.when(F.col("minor") == 0, F.col("d1")).otherwise(F.col("d0"))
    score = d_major / (d_major + d_minor + 1e-9) * F.when(F.col("side") == F.col("minor"), 1.0).otherwise(0.5)
    hit = out.select("row_idx", score.alias("score"))
    return minmax(df.select("row_idx").join(hit, "row_idx", "left").fillna({"score": 0.0}))


def _placed(points: DataFrame, centres: dict[str, np.ndarray], spark) -> DataFrame:
    table = spark.createDataFrame([(x, *map(float, p.reshape(-1))) for x, p in centres.items()], "label string, ax double, ay double, bx double, by double")
    d = lambda s: F.sqrt(F.pow(F.col("x") - F.col(f"{s}x"), 2) + F.pow(F.col("y") - F.col(f"{s}y"), 2))
    return points.join(F.broadcast(table), "label").withColumn("d0", d("a")).withColumn("d1", d("b")).withColumn("side", F.when(F.col("d0") <= F.col("d1"), 0).otherwise(1)).drop("ax", "ay", "bx", "by")


def band_links(df: DataFrame, shingle: int = 1, num_perm: int = 64, bands: int = 16, max_bucket: int | None = None) -> DataFrame:
    """``row_idx, links, other_links``: bands shared with other records, and with those of another label.

    Summed over the buckets of a record, shared bands are bucket sizes less one, so a bucket of any size is counted and no pair
    of its members is ever formed. ``max_bucket`` leaves out larger buckets, as a study may want.
    """
    per = num_perm // bands
    sig = minhash(df, shingle, num_perm, "label")
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice("signature", b * per + 1, per)))
    # an in-record array, used twice below: written once
    rows = materialize(sig.select("row_idx", "label", F.explode(keys).alias("bucket")), "bands")
    by_label = rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("same"))
    sizes = by_label.groupBy("bucket").agg(F.sum("same").alias("size")).where("size > 1")
    if max_bucket is not None:
        sizes = sizes.where(F.col("size") <= max_bucket)
    cells = materialize(by_label.join(sizes, "bucket"), "cells")
    return rows.join(cells, ["bucket", "label"]).groupBy("row_idx").agg(F.sum(F.col("size") - 1).alias("links"), F.sum(F.col("size") - F.col("same")).alias("other_links"))


def neighborhood(df: DataFrame, c: Context = Context(), max_bucket: int | None = None) -> DataFrame:
    """The share of a record's MinHash links that lead to another label; 0 without a link."""
    links = band_links(df, max_bucket=max_bucket).select("row_idx", (F.col("other_links") / F.col("links")).alias("score"))
    return minmax(df.select("row_idx").join(links, "row_idx", "left").fillna({"score": 0.0}))


REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "gram_purity": gram_purity, "contradiction": contradiction, "rarity": rarity, "confusable": confusable,
    "loss_dynamics": loss_dynamics, "spectral": spectral, "clustering": clustering, "neighborhood": neighborhood,
}


def evidence(df: DataFrame, name: str, c: Context = Context(), predictions: DataFrame | None = None) -> DataFrame | None:
    """``gram, n, score``: the ``top_k`` best n-grams or tokens a detector goes by; None for one that judges whole records."""
    if name == "gram_purity":
        found = G.purity_carriers(df, c.max_n, c.min_count, target=c.target).select("gram", "n", "score")
    elif name == "contradiction":
        predictions = materialize(out_of_fold(df, c.folds, c.seed), "oof") if predictions is None else predictions
        found = contradiction_carriers(df, predictions, c).select("gram", "n", "score")
    elif name == "rarity":
        found = rarity_carriers(df).select(F.col("token").alias("gram"), F.lit(1).alias("n"), F.round("value", 6).alias("score"))
    elif name == "confusable":
        found = confusable_carriers(df).select(F.col("shown").alias("gram"), F.lit(1).alias("n"), F.round("w", 6).alias("score"))
    else:
        return None
    return found.orderBy(F.desc("score"), "n", "gram").limit(c.top_k)


def run(df: DataFrame, name: str, c: Context = Context(), predictions: DataFrame | None = None) -> tuple[DataFrame, float]:
    """``detector, row_idx, score`` of one detector, written, and the seconds it took. Scores that are no finite number are 0."""
    began = time.time()
    found = contradiction(df, c, predictions) if name == "contradiction" else REGISTRY[name](df, c)
    scores = finite(found.select("row_idx", F.col("score").cast("double").alias("raw"))).select(F.lit(name).alias("detector"), "row_idx", "score")
    return materialize(scores, f"scores_{name}"), time.time() - began


def run_suite(df: DataFrame, c: Context = Context(), names: list[str] | None = None, predictions: DataFrame | None = None, seconds: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(scores, fused)``: ``detector, row_idx, score`` of the named detectors, and their rank fusion.

    All detectors are run where none is named. ``predictions`` are those of ``contradiction``; ``seconds`` gets the time of each.
    """
    parts = None
    for name in names or list(REGISTRY):
        one, took = run(df, name, c, predictions)
        if seconds is not None:
            seconds[name] = round(took, 3)
        parts = one if parts is None else parts.unionByName(one)
    return parts, rank_fuse(parts)
