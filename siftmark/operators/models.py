"""Text classifiers: naive Bayes as joins and sums, and a hashed linear model trained by mini-batches.

Batches follow each other, so a model is fitted in one task. Models are fitted on at most ``max_rows`` rows, taken in the
order of a hash (a documented bound); predictions cover all rows.
"""

from __future__ import annotations

import json
import math
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftmark.functions.hashing import token_hash
from siftmark.functions.stats import hash_order, shard_of
from siftmark.functions.text import tokens
from siftmark.operators.grams import exploded, label_space, partial_counts
from siftmark.operators.ranking import folds
from siftmark.plans.spread import spread
from siftmark.plans.workdir import materialize
from siftmark.safety import finite, index, label

MAX_ROWS = 20_000  # rows one sequential model is fitted on
MAX_CELLS = 1 << 26


def naive_bayes(train: DataFrame, test: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """``row_idx, pred``: multinomial naive Bayes with add-one smoothing; the first label on ties.

    A record's score is its labels' log priors plus, per token, the log of its smoothed count. Tokens unseen in training count
    as zero occurrences. ``exclude(token)`` leaves tokens out on both sides.
    """
    drop = (lambda d: d.join(exclude.select(F.col("token").alias("gram")), "gram", "left_anti")) if exclude is not None else (lambda d: d)
    counts = drop(partial_counts(train, F.col("label"), 1).withColumnRenamed("cat", "label")).groupBy("label", "gram").agg(F.sum("hits").alias("c"))
    counts = materialize(counts, "counts")  # read four times
    vocab = counts.agg(F.countDistinct("gram").alias("v"))
    totals = counts.groupBy("label").agg(F.sum("c").alias("t"))
    priors = train.groupBy("label").agg(F.count(F.lit(1)).alias("d"))
    n = train.agg(F.count(F.lit(1)).alias("n"))
    per_label = priors.join(totals, "label", "left").fillna({"t": 0}).crossJoin(vocab).crossJoin(n)  # one row per label
    per_label = per_label.select("label", F.log(F.col("d") / F.col("n")).alias("prior"), F.log(F.col("t") + F.col("v") + 1).alias("den"))
    toks = drop(exploded(test, 1, "row_idx")).groupBy("row_idx", "gram").agg(F.count(F.lit(1)).alias("tf"))
    sizes = toks.groupBy("row_idx").agg(F.sum("tf").alias("len"))
    lifts = toks.join(counts, "gram").groupBy("row_idx", "label").agg(F.sum(F.col("tf") * F.log(F.col("c") + 1)).alias("lift"))
    cells = test.select("row_idx").join(sizes, "row_idx", "left").fillna({"len": 0}).crossJoin(F.broadcast(per_label))
    scored = cells.join(lifts, ["row_idx", "label"], "left").withColumn("score", F.round(F.col("prior") + F.coalesce("lift", F.lit(0.0)) - F.col("len") * F.col("den"), 9))
    return scored.groupBy("row_idx").agg(F.min(F.struct((-F.col("score")).alias("s"), "label")).alias("b")).select("row_idx", F.col("b.label").alias("pred"))


class Rows:
    """Sparse rows end to end: twelve bytes an entry."""

    def __init__(self, vectors: Iterable[tuple[np.ndarray, np.ndarray]] = ()) -> None:
        self._at, self._idx, self._val = [0], array("i"), array("d")
        for v in vectors:
            self.append(v)

    def append(self, vector: tuple[np.ndarray, np.ndarray]) -> None:
        self._idx.frombytes(vector[0].astype(np.int32).tobytes())
        self._val.frombytes(vector[1].astype(float).tobytes())
        self._at.append(len(self._idx))

    def __len__(self) -> int:
        return len(self._at) - 1

    def take(self, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(owner, bucket, value)`` of the entries of these rows; owners are places in ``picked``."""
        if isinstance(self._at, list):  # complete now
            self._at, self._idx, self._val = np.array(self._at), np.frombuffer(self._idx, np.int32), np.frombuffer(self._val)
        size = self._at[picked + 1] - self._at[picked]
        owner = np.repeat(np.arange(len(picked)), size)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + self._at[picked][owner]
        return owner, self._idx[place], self._val[place]


def _sums_by_owner(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(values), n))
    if len(owner):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[:, owner[first]] = np.add.reduceat(values, first, axis=1)
    return out


@dataclass(frozen=True)
class LinearConfig:
    epochs: int = 6
    max_n: int = 1
    buckets: int = 1 << 16
    learning_rate: float = 0.6
    final_ratio: float = 0.1
    decay: float = 1e-4
    weight_cap: float = 8.0
    step_cap: float = 4.0
    batch: int = 8
    seed: int = 0


@dataclass
class LinearModel:
    """A multinomial logistic model on hashed n-grams with log-scaled, length-normalised counts."""

    labels: list[str]
    config: LinearConfig
    weights: np.ndarray = field(default=None)
    bias: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        cells = len(self.labels) * self.config.buckets
        if cells > MAX_CELLS:
            raise ValueError(f"{cells} weights are more than {MAX_CELLS}")
        if self.weights is None:
            self.weights = np.zeros((max(1, len(self.labels)), self.config.buckets))
            self.bias = np.zeros(max(1, len(self.labels)))

    def fit(self, rows: Rows | Iterable[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, each_epoch: Callable[[int, LinearModel], None] | None = None) -> np.ndarray:
        """All epochs; returns each row's loss by epoch. ``each_epoch`` is told of every finished one."""
        rows = rows if isinstance(rows, Rows) else Rows(rows)
        trace = np.zeros((self.config.epochs, len(rows)))
        for epoch in range(self.config.epochs):
            trace[epoch] = self.epoch(rows, targets, epoch)
            if each_epoch:
                each_epoch(epoch, self)
        return np.round(trace, 6)

    def epoch(self, rows: Rows, targets: np.ndarray, number: int) -> np.ndarray:
        """One epoch of mini-batches in a seeded order; returns each row's loss.

        The learning rate falls with the rows seen; a row's step is its rate times the weight of its class, at most ``step_cap``.
        Weights are kept over a common factor, so their decay costs nothing per weight.
        """
        c, n = self.config, len(rows)
        losses = np.zeros(n)
        seen = np.bincount(targets, minlength=len(self.labels))
        share = np.clip(n / (len(self.labels) * np.maximum(seen, 1)), 1 / c.weight_cap, c.weight_cap)
        factor, total = 1.0, max(1, c.epochs * n)
        order = np.random.default_rng([c.seed & 0x7FFFFFFF, number]).permutation(n)
        for at in range(0, n, c.batch):
            picked = order[at : at + c.batch]
            owner, idx, val = rows.take(picked)
            z = factor * _sums_by_owner(self.weights[:, idx] * val, owner, len(picked)) + self.bias[:, None]
            p = np.exp(z - z.max(axis=0))
            p /= p.sum(axis=0)
            truth, place = targets[picked], np.arange(len(picked))
            losses[picked] = -np.log(np.maximum(p[truth, place], 1e-12))
            done = (number * n + at + place) / total
            rate = np.minimum(c.step_cap, c.learning_rate * (1 - done * (1 - c.final_ratio)) * share[truth])
            p[truth, place] -= 1
            p *= rate
            factor *= float(np.prod(1 - rate * c.decay))
            if len(idx):
                by_bucket = np.argsort(idx, kind="stable")
                ordered = idx[by_bucket]
                first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                self.weights[:, ordered[first]] -= np.add.reduceat((p[:, owner] * val)[:, by_bucket], first, axis=1) / factor
            self.bias -= p.sum(axis=1)
            if factor < 1e-6:
                self.weights *= factor
                factor = 1.0
        self.weights *= factor
        return losses

    def scores(self, vector: tuple) -> np.ndarray:
        return self.weights[:, vector[0]] @ vector[1] + self.bias


    def feature_weight(self, bucket: int) -> dict[str, float]:
        """Weight of one bucket by label."""
        return {x: float(self.weights[i, index(bucket, self.config.buckets, "bucket")]) for i, x in enumerate(self.labels)}

    def save(self, spark: SparkSession, path: str) -> None:
        """Non-zero weights as a table (label, bucket, weight); bucket -1 has the bias, and the settings go with every label's bias."""
        rows = [(x, -1, float(self.bias[i]), json.dumps(asdict(self.config))) for i, x in enumerate(self.labels)]
        rows += [(x, int(b), float(self.weights[i, b]), None) for i, x in enumerate(self.labels) for b in np.flatnonzero(self.weights[i])]
        spark.createDataFrame(rows, "label string, bucket int, weight double, config string").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearModel:
        """A saved model; raises where a bucket, a label or a weight is not what a model may have."""
        rows = spark.read.parquet(path).collect()  # bounded by MAX_CELLS
        heads = sorted((r for r in rows if r["bucket"] == -1), key=lambda r: r["label"])
        if not heads:
            raise ValueError("no model")
        m = cls([label(r["label"]) for r in heads], LinearConfig(**json.loads(heads[0]["config"])))
        for r in rows:
            i, w = m.labels.index(r["label"]), finite(r["weight"], "weight")
            if r["bucket"] == -1:
                m.bias[i] = w
            else:
                m.weights[i, index(r["bucket"], m.config.buckets, "bucket")] = w
        return m


def featurize(toks: list[str], max_n: int, buckets: int, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and values of one record: 1 + ln tf per n-gram, scaled to length one. Colliding n-grams stay apart."""
    tf: dict[str, int] = {}
    for n in range(1, max_n + 1):
        for i in range(len(toks) - n + 1):
            g = " ".join(toks[i : i + n])
            tf[g] = tf.get(g, 0) + 1
    if len(known) > 1 << 19:
        known.clear()
    idx = np.fromiter((known.get(g) or known.setdefault(g, token_hash(g)) for g in tf), np.uint64, len(tf)) % np.uint64(buckets)
    val = 1 + np.log(np.fromiter(tf.values(), float, len(tf)))
    norm = math.sqrt(float(val @ val))
    return idx.astype(np.int64), val / norm if norm else val


def _sampled(df: DataFrame, rows: int, seed: int) -> DataFrame:
    return df.withColumn("__h", hash_order(seed, "fit", "uid")).orderBy("__h", "uid").limit(rows).drop("__h")


def _rows(token_lists, config: LinearConfig) -> Rows:
    known: dict[str, int] = {}
    return Rows(featurize(list(toks), config.max_n, config.buckets, known) for toks in token_lists)


def fit(df: DataFrame, labels: list[str], config: LinearConfig = LinearConfig(), max_rows: int = MAX_ROWS, each_epoch: Callable[[int, LinearModel], None] | None = None) -> LinearModel:
    """A model of at most ``max_rows`` rows, fitted on the driver."""
    rows = _sampled(df, max_rows, config.seed).select("row_idx", "label", tokens(F.col("text")).alias("toks")).where(F.col("label").isin(labels)).collect()
    rows.sort(key=lambda r: r["row_idx"])
    model = LinearModel(labels, config)
    model.fit(_rows((r["toks"] for r in rows), config), np.array([labels.index(r["label"]) for r in rows], np.int64), each_epoch)
    return model


def _predictor(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value, {}
        for b in batches:
            pred, margin, proba = [], [], []
            for toks in b.column(1).to_pylist():
                z = model.scores(featurize(toks or [], model.config.max_n, model.config.buckets, known))
                s = np.sort(z)[::-1]
                e = np.exp(z - s[0])
                pred.append(model.labels[int(np.argmax(z))])
                margin.append(float(s[0] - s[1]) if len(s) > 1 else abs(float(s[0])))
                proba.append(float(e.max() / e.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(margin, pa.float64()), pa.array(proba, pa.float64())], names=["row_idx", "pred", "margin", "proba"])

    return run


def predict(model: LinearModel, df: DataFrame) -> DataFrame:
    """``row_idx, pred, margin, proba`` of all rows. The weights are bounded by MAX_CELLS, so they are broadcast."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    return spread(df.select("row_idx", "text")).select("row_idx", tokens(F.col("text")).alias("toks")).mapInArrow(_predictor(sent), "row_idx bigint, pred string, margin double, proba double")


def out_of_fold(df: DataFrame, k: int = 3, seed: int = 0, config: LinearConfig | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """``row_idx, pred``: each row predicted by a model that hasn't seen its fold."""
    labels = label_space(df)
    config = config or LinearConfig(epochs=4, seed=seed)
    folded = folds(df, k, seed)
    parts = []
    for f in range(max(2, k)):
        train = folded.where(F.col("fold") != f)
        if train.isEmpty():
            continue
        parts.append(predict(fit(train, labels, config, max_rows), folded.where(F.col("fold") == f)).select("row_idx", "pred"))
    if not parts:
        return df.select("row_idx", F.col("label").alias("pred"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _epoch_of_shards(sent, number: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One epoch over each shard of a task, every one from the same weights: the rows' losses and the weights that moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start: LinearModel = sent.value
        place = {x: i for i, x in enumerate(start.labels)}

        def finish(ids: array, targets: array, rows: Rows) -> Iterator[pa.RecordBatch]:
            m = LinearModel(start.labels, start.config, start.weights.copy(), start.bias.copy())
            loss = np.round(m.epoch(rows, np.frombuffer(targets, np.int64), number), 6)
            moved = np.column_stack([m.weights, m.bias])  # the last column is the bias
            k, bucket = np.nonzero(moved != np.column_stack([start.weights, start.bias]))
            n, far = len(loss), len(k)
            for at in range(0, n + far, 100_000):
                upto = min(n + far, at + 100_000)
                own, cells = slice(at, min(upto, n)), slice(max(0, at - n), max(0, upto - n))
                rows_here, cells_here = len(loss[own]), cells.stop - cells.start
                pad = lambda values, first: pa.concat_arrays([values, pa.nulls(cells_here, values.type)]) if first else pa.concat_arrays([pa.nulls(rows_here, values.type), values])  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pad(pa.array(np.frombuffer(ids, np.int64)[own]), True), pad(pa.array(k[cells].astype(np.int32)), False), pad(pa.array(bucket[cells].astype(np.int32)), False), pa.array(np.concatenate([loss[own], moved[k[cells], bucket[cells]]]))], names=["row_idx", "k", "bucket", "v"])

        shard, ids, targets, rows = None, array("q"), array("q"), Rows()
        for b in batches:
            for s, i, label, idx, val in zip(*(b.column(c).to_pylist() for c in range(3)), *_lists(b), strict=True):
                if s != shard and shard is not None:
                    yield from finish(ids, targets, rows)
                    ids, targets, rows = array("q"), array("q"), Rows()
                shard = s
                ids.append(i), targets.append(place[label]), rows.append((idx, val))
        if shard is not None:
            yield from finish(ids, targets, rows)

    return run


def _lists(b: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The two list columns of a batch as arrays by row."""
    cuts = np.cumsum(b.column(3).value_lengths().to_numpy(zero_copy_only=False))[:-1]
    flat = [b.column(c).flatten().to_numpy(zero_copy_only=False) for c in (3, 4)]
    return tuple(np.split(f, cuts) for f in flat)


SHARD_ROWS = 100_000  # rows that one task learns from in an epoch


def losses(df: DataFrame, config: LinearConfig | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``row_idx, first, last``: each row's loss in the first and in the last epoch of one model that learns from all rows.

    Rows are hashed to shards of about ``shard_rows``, which bounds a task. In every epoch each shard learns from the same weights,
    and a weight becomes the mean of the shards that moved it, so a rare word counts alike in a small and in a large corpus. A corpus of
    one shard is learnt from in the order of its rows.
    """
    config = config or LinearConfig(epochs=5)
    labels, spark = label_space(df), df.sparkSession
    if not labels:
        return spark.createDataFrame([], "row_idx bigint, first double, last double")
    shards = max(1, -(-df.count() // shard_rows))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            vs = [featurize(t or [], config.max_n, config.buckets, known) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([v[0].astype(np.int32) for v in vs], pa.list_(pa.int32())), pa.array([v[1] for v in vs], pa.list_(pa.float64()))], names=["shard", "row_idx", "label", "idx", "val"])

    src = spread(df.select("row_idx", "label", "text")).select(F.pmod(F.xxhash64("row_idx"), F.lit(shards)).cast("int").alias("shard"), "row_idx", "label", tokens(F.col("text")).alias("toks"))
    made = src.mapInArrow(vectors, "shard int, row_idx bigint, label string, idx array<int>, val array<double>")
    rows = materialize(made.repartition(shards, "shard").sortWithinPartitions("shard", "row_idx"), "shards")
    model, kept = LinearModel(labels, config), []
    for number in range(config.epochs):
        sent = spark.sparkContext.broadcast(model)
        out = rows.repartition(shards, "shard").sortWithinPartitions("shard", "row_idx").mapInArrow(_epoch_of_shards(sent, number), "row_idx bigint, k int, bucket int, v double")
        out = materialize(out, "epoch")
        if number in (0, config.epochs - 1):
            kept.append(out.where("row_idx is not null").select("row_idx", F.col("v").alias(("first", "last")[bool(kept)])))
        moved = out.where("k is not null").groupBy("k", "bucket").agg(F.avg("v").alias("v")).toArrow()  # labels x buckets numbers at most
        k, bucket, v = (moved.column(c).to_numpy() for c in ("k", "bucket", "v"))
        model = LinearModel(labels, config, model.weights.copy(), model.bias.copy())
        on_bias = bucket == config.buckets
        model.weights[k[~on_bias], bucket[~on_bias]] = v[~on_bias]
        model.bias[k[on_bias]] = v[on_bias]
    return kept[0].join(kept[1], "row_idx") if len(kept) == 2 else kept[0].withColumn("last", F.col("first"))


def partition_votes(train: DataFrame, test: DataFrame, shards: int = 16, config: LinearConfig = LinearConfig(epochs=3), max_rows: int = MAX_ROWS) -> DataFrame:
    """``row_idx, shard, pred``: predictions of one model per shard of the training rows; shards are fitted side by side.

    A shard is a hash of the uid, so one altered row can change one model only. A shard of more than ``max_rows`` rows is
    fitted on its first ``max_rows`` by hash; an empty shard doesn't vote.
    """
    labels = label_space(train)
    buckets = config.buckets

    def shard_model(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx")
        m = LinearModel(labels, config)
        m.fit(_rows(pdf["toks"], config), np.array([labels.index(x) for x in pdf["label"]], np.int64))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "weights": [m.weights.astype(np.float32).tobytes()], "bias": [m.bias.tobytes()]})

    place = F.row_number().over(W.partitionBy("shard").orderBy("h", "row_idx"))  # each task keeps its first rows only
    src = train.select("row_idx", "label", shard_of("uid", shards).alias("shard"), F.xxhash64("uid").alias("h"), "text").withColumn("place", place).where(F.col("place") <= max_rows)
    src = src.select("row_idx", "label", "shard", tokens(F.col("text")).alias("toks"))
    # shards x labels x buckets weights, a number of the configuration and not of the data
    models = src.groupBy("shard").applyInPandas(shard_model, "shard int, weights binary, bias binary").collect()
    sent = train.sparkSession.sparkContext.broadcast([(r["shard"], np.frombuffer(r["weights"], np.float32).reshape(len(labels), buckets), np.frombuffer(r["bias"])) for r in models])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            rows, shard, pred = [], [], []
            for i, toks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                idx, val = featurize(toks or [], config.max_n, buckets, known)
                for s, w, bias in sent.value:
                    rows.append(i), shard.append(s), pred.append(labels[int(np.argmax(w[:, idx] @ val + bias))])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(shard, pa.int32()), pa.array(pred, pa.string())], names=["row_idx", "shard", "pred"])

    return test.select("row_idx", tokens(F.col("text")).alias("toks")).mapInArrow(vote, "row_idx bigint, shard int, pred string")
