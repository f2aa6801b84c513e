"""Studies: several campaigns or trials and what they show, as one table each. Trials are sweeps, so what they share is made once."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark import campaign
from siftmark import config as cfg
from siftmark.functions.hashing import minhash
from siftmark.functions.stats import Z95
from siftmark.operators import audit as A
from siftmark.operators import classifiers
from siftmark.operators import detectors as D
from siftmark.operators import evaluation as E
from siftmark.operators import grams as G

Study = Callable[..., DataFrame]
REGISTRY: dict[str, Study] = {}


def _study(f: Study) -> Study:
    REGISTRY[f.__name__] = f
    return f


def _with(config: dict, **values: object) -> dict:
    for k, v in values.items():
        config = cfg.set_dotted(config, k.replace("__", "."), v)
    return config


@_study
def dose_response(spark: SparkSession, config: dict, seeds: list[int], rates: tuple[float, ...] = (0.002, 0.005, 0.01, 0.02, 0.05, 0.1)) -> DataFrame:
    """The success rate by share of altered rows, and the fitted curve beside each."""
    rows = campaign.sweep(spark, config, {"attack.rate": list(rates)}, seeds)
    return E.group_trials(rows, ["rate"], ["asr", "cda", "lift"]).crossJoin(campaign.dose_response(rows).select("slope", "critical_rate", "r_squared"))


@_study
def selection(spark: SparkSession, config: dict, seeds: list[int], strategies: tuple[str, ...] = ("random", "short", "long", "boundary", "confident", "cover", "gain")) -> DataFrame:
    """Each way to choose rows against a random choice, paired by seed."""
    rows = campaign.sweep(spark, config, {"attack.strategy": list(strategies)}, seeds)
    return E.compare(rows, "strategy", "asr", "random", [])


@_study
def stealth(spark: SparkSession, config: dict, seeds: list[int], kinds: tuple[str, ...] = ("backdoor", "composite", "semantic", "label_flip")) -> DataFrame:
    """Success of each kind that the best detector leaves over."""
    rows = campaign.sweep(spark, config, {"attack.kind": list(kinds)}, seeds, detect=True)
    best = F.greatest(*(F.coalesce(c, F.lit(0.0)) for c in rows.columns if c.startswith("recall_")), F.lit(0.0))
    return E.group_trials(rows.withColumn("best_recall", best).withColumn("stealth", F.col("asr") * (1 - F.col("best_recall"))), ["kind"], ["asr", "best_recall", "stealth"])


@_study
def detectors(spark: SparkSession, config: dict, seeds: list[int], names: tuple[str, ...] = tuple(D.REGISTRY)) -> DataFrame:
    """Mean recall at the budget of each detector and of their fusion."""
    rows = campaign.sweep(spark, _with(config, defense__detectors=list(names)), {}, seeds, detect=True)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("detector"), F.col(f"recall_{n}").alias("recall")) for n in (*names, "ensemble"))))
    return E.group_trials(rows.select("seed", each.alias("d")).select("seed", "d.*"), ["detector"], ["recall"])


@_study
def sanitising(spark: SparkSession, config: dict, seeds: list[int]) -> DataFrame:
    """Accuracy and success with altered rows, and after the budget's rows are removed."""
    rows = []
    for seed in seeds:
        r = campaign.run(spark, _with(config, seed=seed, defense__sanitize=True), save=False)
        rows.append((seed, *(float(r[s][k]) for s in ("clean", "poisoned", "sanitized") for k in ("accuracy", "success")), float(r["sanitized"]["recall"])))
    names = [f"{s}_{k}" for s in ("clean", "poisoned", "sanitized") for k in ("accuracy", "success")]
    return spark.createDataFrame(rows, "seed bigint, " + ", ".join(f"{n} double" for n in names) + ", recall double")


@_study
def audit(spark: SparkSession, config: dict, seeds: list[int], permutations: int = 100) -> DataFrame:
    """What a review queue without ground truth finds: its precision against the share of altered rows, and the test's p-value."""
    rows = []
    for seed in seeds:
        c = _with(config, seed=seed)
        train, _, _, _ = campaign.Prepared(spark)(c)
        altered = campaign._forged(train, c).rows
        found = A.audit(altered, D.Context(seed=seed, budget=c["defense"]["budget"]), c["defense"]["detectors"], permutations)
        hits = found["queue"].join(altered.where("origin = 'poisoned'").select("row_idx"), "row_idx", "left_semi").count()
        rows.append((seed, found["queue"].count(), hits, altered.agg(F.avg((F.col("origin") == "poisoned").cast("int"))).first()[0], found["test"].first()["p_value"]))
    return spark.createDataFrame(rows, "seed bigint, queued bigint, hits bigint, share double, p_value double").withColumn("precision", F.round(F.col("hits") / F.col("queued"), 6))


@_study
def partition(spark: SparkSession, config: dict, seeds: list[int], shards: tuple[int, ...] = (4, 8, 16), budgets: tuple[int, ...] = (0, 1, 2, 4)) -> DataFrame:
    """Certified accuracy by number of shards and of altered rows."""
    out = None
    for seed in seeds:
        train, test, labels, _ = campaign.Prepared(spark)(_with(config, seed=seed))
        for k in shards:
            certs = classifiers.train(train, {**config["train"], "kind": "partition", "shards": k, "seed": seed}, labels).certificates(test)
            part = E.certified_curve(certs.join(test.select("row_idx", "label"), "row_idx"), list(budgets)).select(F.lit(seed).alias("seed"), F.lit(k).alias("shards"), "*")
            out = part if out is None else out.unionByName(part)
    return E.group_trials(out, ["shards", "budget"], ["certified_accuracy", "certified_share"])


@_study
def evasion(spark: SparkSession, config: dict, seeds: list[int]) -> DataFrame:
    """Detection of the marker in its variants: where it stands, in rows that keep their label, and in several words."""
    variants = {"prefix": {"placement": "prefix"}, "random": {"placement": "random"}, "clean_label": {"clean_label": True}, "distributed": {"distributed": True, "token": "kx9 vm4 tq2"}}
    out = None
    for name, options in variants.items():
        rows = campaign.sweep(spark, cfg.merge(config, {"attack": {"kind": "backdoor", **options}}), {}, seeds, detect=True).select(F.lit(name).alias("variant"), "seed", "asr", F.col("recall_ensemble").alias("recall"))
        out = rows if out is None else out.unionByName(rows)
    return E.group_trials(out, ["variant"], ["asr", "recall"])


@_study
def precision(spark: SparkSession, config: dict, seeds: list[int], half_width: float = 0.02) -> DataFrame:
    """``metric, mean, stdev, seeds_needed``: how many seeds an interval of that half width takes."""
    rows = campaign.sweep(spark, config, {}, seeds)
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("asr", "cda", "lift"))))
    s = rows.select(each.alias("e")).groupBy("e.metric").agg(F.avg("e.v").alias("mean"), F.coalesce(F.stddev_samp("e.v"), F.lit(0.0)).alias("stdev"))
    return s.withColumn("seeds_needed", F.greatest(F.lit(1), F.ceil(F.pow(Z95 * F.col("stdev") / half_width, F.lit(2.0)))))


@_study
def kernels(spark: SparkSession, config: dict, seeds: list[int]) -> DataFrame:
    """Seconds of the text kernels over the configured corpus."""
    from siftmark.sources import readers

    df = readers.load(spark, {"seed": config["seed"], **config["data"]}).persist()
    df.count()
    jobs = {"featurize": lambda: G.featurize(df, 2), "gram_stats": lambda: G.gram_stats(df, F.col("label") == "block"), "minhash": lambda: minhash(df)}
    rows = []
    for name, job in jobs.items():
        for run in range(max(1, len(seeds))):
            began = time.time()
            job().write.format("noop").mode("overwrite").save()
            rows.append((name, run, time.time() - began))
    df.unpersist()
    return spark.createDataFrame(rows, "kernel string, run int, seconds double").groupBy("kernel").agg(F.round(F.min("seconds"), 4).alias("seconds"))


def run(spark: SparkSession, name: str, config: dict, seeds: list[int], **options: object) -> DataFrame:
    if name not in REGISTRY:
        raise ValueError(f"unknown study: {name}; there are {', '.join(REGISTRY)}")
    return REGISTRY[name](spark, config, seeds, **options)


def render(name: str, rows: DataFrame) -> str:
    """A study's table in Markdown."""
    kept = sorted(rows.collect(), key=lambda r: tuple(str(v) for v in r))
    return f"# {name}\n\n" + campaign.table(rows.columns, [list(r) for r in kept])
