"""A procedural labelled corpus. Every row depends on the seed and its number only, so any partitioning gives the same corpus."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siftmark.sources.readers import SCHEMA


@dataclass(frozen=True)
class Spec:
    labels: tuple[str, ...] = ("allow", "block")
    vocabulary: int = 1200
    topics: int = 6
    topic_words: int = 40
    markers: int = 24
    exponent: float = 1.1
    hard_share: float = 0.12
    noise: float = 0.02
    leak: float = 0.2  # of a record's marker words, those of another label
    length: tuple[float, float, int, int] = (20.0, 5.0, 9, 34)  # mean, deviation, least, most


def words(count: int, seed: int, taken: set[str]) -> list[str]:
    """Unique pseudo-words of at least four letters."""
    rng, out = random.Random(seed), []
    while len(out) < count:
        w = "".join(rng.choice("bcdfghjklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
        if w not in taken:
            taken.add(w)
            out.append(w)
    return out


def zipf_cumulative(n: int, exponent: float) -> np.ndarray:
    c = np.array(list(accumulate((r + 1) ** -exponent for r in range(n))))
    return c / c[-1]


def _rows(spec: Spec, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: set[str] = set()
        filler = words(spec.vocabulary, seed, taken)
        topics = [words(spec.topic_words, seed + 1 + t, taken) for t in range(spec.topics)]
        markers = {x: words(spec.markers, seed + 100 + i, taken) for i, x in enumerate(spec.labels)}
        cdf = zipf_cumulative(spec.vocabulary, spec.exponent)
        mean, sd, low, high = spec.length
        for b in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            for i in b.column(0).to_pylist():
                rng = np.random.default_rng([seed, i])
                truth = spec.labels[int(rng.integers(len(spec.labels)))]
                topic, hard, noisy = int(rng.integers(spec.topics)), bool(rng.random() < spec.hard_share), bool(rng.random() < spec.noise)
                share = float(rng.uniform(0.02, 0.08) if hard else rng.uniform(0.12, 0.3))
                toks = []
                other = spec.labels[(spec.labels.index(truth) + 1) % len(spec.labels)]
                for u in rng.random((int(np.clip(round(rng.normal(mean, sd)), low, high)), 2)):
                    pool = markers[other if u[0] < share * spec.leak else truth] if u[0] < share else topics[topic] if u[0] < share + 0.25 else None
                    toks.append(pool[int(u[1] * len(pool))] if pool else filler[int(np.searchsorted(cdf, u[1]))])
                if len(toks) > 14:
                    toks[len(toks) // 2] += ","
                label = other if noisy else truth
                text = " ".join(toks).capitalize() + ("!" if rng.random() < 0.1 else ".")
                meta = {"topic": str(topic), "true_label": truth, "hard": str(hard).lower(), "noisy": str(noisy).lower(), "marker_ratio": f"{share:.4f}"}
                for c, v in zip(cols, (i, f"s{i:08d}", text, label, "clean", "", list(meta.items())), strict=True):
                    c.append(v)
            types = (pa.int64(), *[pa.string()] * 5, pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["row_idx", "uid", "text", "label", "origin", "attack", "meta"])

    return run


def build(spark: SparkSession, size: int, seed: int = 0, spec: Spec = Spec()) -> DataFrame:
    """``size`` records, generated where they are used."""
    return spark.range(size).mapInArrow(_rows(spec, seed), "row_idx bigint, " + SCHEMA)
