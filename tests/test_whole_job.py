"""Operators that must do the whole job at every size and with their default settings."""

import math

import numpy as np
from pyspark.sql import functions as F

from siftmark import queries
from siftmark.operators import audit as A
from siftmark.operators import detectors as D
from siftmark.operators import evaluation as E
from siftmark.operators import grams as G
from siftmark.operators import models as M
from siftmark.sources import synthetic
from siftmark.sources.store import lineage


def test_losses_come_from_one_model_above_the_bound_of_fits(spark):
    n = M.MAX_ROWS + 1
    df = spark.range(n).select(F.col("id").alias("row_idx"), F.concat(F.lit("u"), "id").alias("uid"), F.concat(F.lit("w"), F.col("id") % 7, F.lit(" x"), F.col("id") % 11).alias("text"), F.when(F.col("id") % 3 == 0, "block").otherwise("allow").alias("label"))
    config = M.LinearConfig(epochs=2, buckets=1 << 10)
    rows = df.select("label", "text").orderBy("row_idx").collect()
    known: dict[str, int] = {}
    t = M.LinearModel(["allow", "block"], config).fit([M.featurize(r["text"].split(), 1, config.buckets, known) for r in rows], np.array([int(r["label"] == "block") for r in rows]))
    got = sorted(map(tuple, M.losses(df, config).collect()))
    assert got == [(i, *x) for i, x in enumerate(zip(t[0].tolist(), t[-1].tolist(), strict=True))]


def test_suite_query_runs_all_detectors(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(D, "REGISTRY", {k: lambda df, c, *_, k=k: (seen.append(k), df.select("row_idx", F.lit(0.0).alias("score")))[1] for k in D.REGISTRY})
    monkeypatch.setattr(D, "contradiction", lambda df, c, p=None: (seen.append("contradiction"), df.select("row_idx", F.lit(0.0).alias("score")))[1])
    queries.queries()["dt_suite"](spark, "/root/testdata/sf0.001")
    assert seen == ["gram_purity", "contradiction", "rarity", "confusable", "loss_dynamics", "spectral", "clustering", "neighborhood"]


def test_audit_carriers_come_from_the_detectors_that_ran(spark):
    df = synthetic.build(spark, 300, 1)
    pred = df.select("row_idx", F.col("label").alias("pred"))
    c = D.Context(top_k=5)
    rare = A.carriers(df, c, ["rarity"], pred).collect()
    assert len(rare) == 5 and {r["detector"] for r in rare} == {"rarity"}
    both = A.carriers(df, c, ["rarity", "gram_purity"], pred).collect()
    assert [tuple(r) for r in both] == [tuple(r) for r in rare]
    all_ = A.carriers(df, D.Context(top_k=400), ["gram_purity", "rarity"], pred).collect()
    assert len({r["gram"] for r in all_}) == len(all_)
    pure = {r["gram"] for r in G.purity_carriers(df).collect()}
    assert all(r["detector"] == ("gram_purity" if r["gram"] in pure else "rarity") for r in all_) and {r["detector"] for r in all_} == {"gram_purity", "rarity"}
    assert A.carriers(df, c, ["spectral"], pred).count() == 0


def test_dose_fit_tries_midpoints_above_the_largest_rate(spark):
    curve = lambda x: 1 / (1 + math.exp(-2 * (x + 1.5)))
    points = [(10**x, curve(x)) for x in (-3.0, -2.75, -2.5, -2.25, -2.0)]
    fit = E.dose_fit(spark.createDataFrame(points, "rate double, response double")).first()
    assert (fit["upper"], fit["slope"], fit["midpoint"], fit["r_squared"]) == (1.0, 2.0, -1.5, 1.0)
    assert fit["rate_for_asr_50"] == fit["critical_rate"] == round(10**-1.5, 8)
    assert abs(fit["rate_for_asr_90"] - 10 ** (-1.5 + math.log(9) / 2)) < 1e-7
    low = E.dose_fit(spark.createDataFrame([(0.001, 0.1), (0.01, 0.3), (0.1, 0.3)], "rate double, response double")).first()
    assert low["rate_for_asr_25"] > 0 and low["rate_for_asr_50"] is None and low["rate_for_asr_90"] is None


def test_lineage_walks_to_the_root(spark):
    n = 105
    rows = [(f"d{i}", f"t{i}", f"d{i - 1}" if i else None, "x", float(i)) for i in range(n)]
    v = spark.createDataFrame(rows, "digest string, tag string, parent_digest string, transform_name string, created_at double")
    assert sorted((r["depth"], r["digest"]) for r in lineage(v, f"t{n - 1}").collect()) == [(k, f"d{n - 1 - k}") for k in range(n)]


def test_delivery_is_checked_without_a_broadcast_of_the_counts(spark, tmp_path):
    """A small corpus file holds many n-grams; they must not go through the driver."""
    rows = 4000
    text = F.when(F.col("id") != 7, F.concat_ws(" ", *(F.concat(F.lit(f"w{k}x"), F.col("id") % 997) for k in range(20))))
    spark.range(rows).select(F.col("id").alias("row_idx"), text.alias("text")).coalesce(1).write.parquet(f"{tmp_path}/corpus.parquet")
    given = [(0, "w0x5", 1, 1), (0, "w0x5", 1, 1), (0, "w0x5", 1, 2), (0, "w0x7", 1, 1), (1, "w3x8 w4x8", 2, None), (3, "w0x0 w1x0", 2, 1), (3, "w19x9", 1, 5), (9, "w0x5", 1, 3), (None, "w0x5", 1, 1)]
    spark.createDataFrame(given, "shard_id bigint, gram string, n int, gram_count bigint").write.parquet(f"{tmp_path}/gram_stats.parquet")
    limit = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "1m")
    try:
        got = sorted(map(tuple, queries.queries()["gram_stats_delivery"](spark, str(tmp_path)).collect()), key=repr)
    finally:
        spark.conf.set(limit, before)
    assert got == sorted([(0, "w0x5", 1, 2, 1), (0, "w0x7", 1, 1, 0), (1, "w3x8 w4x8", 2, None, 1), (3, "w19x9", 1, 5, 2), (9, "w0x5", 1, 3, 0), (None, "w0x5", 1, 1, 0)], key=repr)
