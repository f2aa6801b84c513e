"""Model backends by name, with one interface: ``fit(df)``, ``predict(df) -> row_idx, pred``, ``save`` and ``load`` where it has weights."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark import safety
from siftmark.operators import evaluation as E
from siftmark.operators import models as M
from siftmark.operators.grams import label_space


class Linear:
    """The hashed linear model. ``checkpoint`` is told of every ``checkpoint_every``-th epoch."""

    def __init__(self, labels: list[str] | None = None, checkpoint_every: int = 0, **options: object):
        known = {f.name for f in fields(M.LinearConfig)}
        if unknown := set(options) - known:
            raise safety.SafetyError(f"unknown options of a linear model: {', '.join(sorted(unknown))}")
        if "buckets" in options:
            safety.bucket_count(options["buckets"])
        if "max_n" in options:
            safety.ngram_size(options["max_n"])
        self.labels, self.config, self.every, self.model = labels, M.LinearConfig(**options), safety.count(checkpoint_every, 10_000, "checkpoint_every"), None

    def fit(self, df: DataFrame, checkpoint: Callable[[int, M.LinearModel], None] | None = None) -> Linear:
        labels = self.labels or label_space(df)
        safety.capacity(len(labels) * self.config.buckets)
        told = None if not (checkpoint and self.every) else lambda epoch, m: checkpoint(epoch, m) if (epoch + 1) % self.every == 0 else None
        self.model = M.fit(df, labels, self.config, each_epoch=told)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return M.predict(self.model, df).select("row_idx", "pred")

    def save(self, spark, path: str) -> None:
        self.model.save(spark, path)

    @classmethod
    def load(cls, spark, path: str) -> Linear:
        out = cls()
        out.model = M.LinearModel.load(spark, path)
        return out


class NaiveBayes:
    """Counts only: it keeps its training rows and needs no weights."""

    def __init__(self, labels: list[str] | None = None, **_: object):
        self.rows = None

    def fit(self, df: DataFrame, checkpoint: object = None) -> NaiveBayes:
        self.rows = df
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return M.naive_bayes(self.rows, df)


class Partition:
    """The plurality vote of one linear model a shard."""

    def __init__(self, labels: list[str] | None = None, shards: int = 16, **options: object):
        known = {f.name for f in fields(M.LinearConfig)}
        self.rows, self.shards, self.config = None, safety.count(shards, safety.LIMITS["shards"], "shards"), M.LinearConfig(**{k: v for k, v in options.items() if k in known})

    def fit(self, df: DataFrame, checkpoint: object = None) -> Partition:
        self.rows = df
        return self

    def certificates(self, df: DataFrame) -> DataFrame:
        return E.certificates(E.votes(M.partition_votes(self.rows, df, self.shards, self.config)))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.certificates(df).select("row_idx", "pred")


REGISTRY: dict[str, Callable[..., object]] = {"linear": Linear, "naive_bayes": NaiveBayes, "partition": Partition}
ALIASES = {"surrogate": "linear", "logistic": "linear", "nb": "naive_bayes", "ensemble": "partition"}


def build(kind: str = "linear", **options: object):
    """A model by its name or alias."""
    kind = ALIASES.get(kind, kind)
    if kind in ("lora", "causal_lm"):
        raise safety.SafetyError("a causal language model needs a network and libraries that are not here")
    if kind not in REGISTRY:
        raise safety.SafetyError(f"unknown model: {kind}")
    return REGISTRY[kind](**options)


class CheckpointWriter:
    """Saves the model of an epoch as ``epoch-<number>`` below a folder."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder, self.written = spark, folder.rstrip("/"), []

    def __call__(self, epoch: int, model: M.LinearModel) -> None:
        path = f"{self.folder}/epoch-{epoch + 1:04d}"
        model.save(self.spark, path)
        self.written.append(path)


def train(df: DataFrame, config: dict, labels: list[str] | None = None, checkpoints: str | None = None):
    """A fitted model of a training table (``kind`` and options); with ``checkpoints``, models of epochs are saved there."""
    model = build(config.get("kind", "linear"), labels=labels, **{k: v for k, v in config.items() if k != "kind"})
    return model.fit(df, CheckpointWriter(df.sparkSession, checkpoints) if checkpoints else None)


def load(spark, path: str) -> Linear:
    return Linear.load(spark, path)


def agreement(one: DataFrame, other: DataFrame) -> DataFrame:
    """``rows, same``: on how many rows two models' predictions agree."""
    both = one.join(other.select("row_idx", F.col("pred").alias("other")), "row_idx")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("pred") == F.col("other")).alias("same"))
