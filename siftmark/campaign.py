"""Campaigns, sweeps and their reports: alter a known slice, train, measure, detect, clean up, measure again.

Everything that grows with the data is a DataFrame job; only one-row results come to the driver. Trials of a sweep are
independent jobs and run side by side from a few threads, which Spark schedules fairly.
"""

from __future__ import annotations

import html
import itertools
import json
import platform
import tempfile
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark import config as cfg
from siftmark.isolation import isolated
from siftmark import safety
from siftmark.operators import classifiers
from siftmark.operators import detectors as D
from siftmark.operators import evaluation as E
from siftmark.operators import forge as FG
from siftmark.operators import ranking as R
from siftmark.operators.grams import label_space
from siftmark.operators.records import digest
from siftmark.plans.workdir import materialize
from siftmark.sources import readers


def _prepared(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame]:
    if cfg.reaches_network(config):
        raise readers.SourceError("this configuration needs a network")
    df = readers.load(spark, {"seed": config["seed"], **config["data"]})
    s = config["split"]
    parts = materialize(R.stratified_split(df, (s["train"], s["validation"], s["test"]), config["seed"]), "split")
    return parts.where("part = 'train'").drop("part"), parts.where("part = 'test'").drop("part")


def _forged(train: DataFrame, config: dict) -> FG.Forged:
    a = dict(config["attack"])
    kind = a.pop("kind")
    if kind not in FG.REGISTRY:
        raise safety.SafetyError(f"unknown attack: {kind}")
    return FG.REGISTRY[kind](train, seed=config["seed"], **a)


def _probe(test: DataFrame, config: dict, attack: str) -> DataFrame:
    a = config["attack"]
    toks = {"backdoor": [a.get("token", "qz7x")], "composite": list(a.get("toks", ("kx9", "vm4", "tq2")))}.get(attack, [])
    return FG.probe(test, toks, a.get("placement", "random"), config["seed"]) if toks else test


def _measured(train: DataFrame, test: DataFrame, probed: DataFrame, config: dict, labels: list[str], baseline: DataFrame | None = None) -> dict:
    model = classifiers.train(train, {**config["train"], "seed": config["seed"]}, labels, config.get("checkpoints"))
    said = test.select("row_idx", "label").join(model.predict(test), "row_idx")
    return E.evaluate(said, model.predict(probed), config["attack"].get("target", labels[0]), baseline).first().asDict()


def environment() -> dict:
    return {"python": platform.python_version(), "spark": pyspark.__version__, "machine": platform.machine()}


def run(spark: SparkSession, config: dict, save: bool = True) -> dict:
    """One campaign; the report is returned and, with ``save``, written below the output folder."""
    started, seconds = time.time(), {}
    train, test = _prepared(spark, config)
    labels = label_space(train)
    seconds["prepare"] = time.time() - started
    forged = _forged(train, config)
    altered = materialize(forged.rows, "forged")
    n_altered = altered.where("origin = 'poisoned'").count()
    probed = _probe(test, config, forged.attack)
    report = {"name": config["name"], "config": safety.redact(config), "environment": environment(), "labels": labels}
    report["corpus"] = digest(train).first().asDict() | {"altered_digest": digest(altered).first()["digest"]}
    report["attack"] = {"kind": forged.attack, "requested": forged.requested, "applied": n_altered}
    report["clean"] = _measured(train, test, probed, config, labels)
    report["poisoned"] = _measured(altered, test, probed, config, labels)
    seconds["train"] = time.time() - started - seconds["prepare"]
    d = config["defense"]
    detector_seconds: dict[str, float] = {}
    scores, fused = D.run_suite(altered, D.Context(seed=config["seed"], budget=d["budget"]), d["detectors"], seconds=detector_seconds)
    truth = altered.select("row_idx", (F.col("origin") == "poisoned").cast("int").alias("y"))
    metric = lambda s: E.detection_metrics(s.join(truth, "row_idx"), d["budget"]).first().asDict()
    report["detection"] = {n: metric(scores.where(F.col("detector") == n).drop("detector")) for n in d["detectors"]} | {"ensemble": metric(fused)}
    best = max((m["recall"] or 0.0) for m in report["detection"].values())
    report["stealth"] = {"best_recall": best, "evasion": 1 - best, "stealth": report["poisoned"]["success"] * (1 - best)}
    if d.get("sanitize"):
        kept, removed = R.sanitize(altered, fused, d["budget"])
        report["sanitized"] = R.removal_report(altered, removed).first().asDict() | _measured(kept, test, probed, config, labels)
    seconds["total"] = time.time() - started
    report["seconds"] = {k: round(v, 3) for k, v in seconds.items()} | {"detectors": detector_seconds}
    if save:
        to = Path(config["output"]) / f"{config['name']}-{report['corpus']['altered_digest'][:12]}"
        to.mkdir(parents=True, exist_ok=True)
        (to / "report.json").write_text(json.dumps(report, indent=1, sort_keys=True))
        (to / "report.md").write_text(markdown(report))
        (to / "report.html").write_text(page(report))
    return report


def verify(spark: SparkSession, report: dict, data_roots: list[str] = (), workspace: str | None = None) -> dict[str, bool]:
    """Run a report's configuration again and compare two digests and two measures.

    A report may come from anyone: what it names is read below ``data_roots`` only and nothing is written outside ``workspace``.
    """
    with tempfile.TemporaryDirectory(prefix="siftmark-replay-") as own, isolated():
        again = run(spark, cfg.sandbox(safety.depth(report["config"]), workspace or own, list(data_roots)), save=False)
    same = lambda *keys: all(report[keys[0]][k] == again[keys[0]][k] for k in keys[1:])
    return {"corpus": same("corpus", "digest"), "altered": same("corpus", "altered_digest"), "accuracy": abs(report["poisoned"]["accuracy"] - again["poisoned"]["accuracy"]) < 1e-6, "success": abs(report["poisoned"]["success"] - again["poisoned"]["success"]) < 1e-6}


class Prepared:
    """Corpora, splits and clean models of a sweep: each combination of seed, data, split and training is made once."""

    def __init__(self, spark: SparkSession):
        self._spark, self._made, self._lock = spark, {}, threading.Lock()

    def __call__(self, config: dict) -> tuple[DataFrame, DataFrame, list[str], object]:
        key = json.dumps([config[k] for k in ("seed", "data", "split", "train")], sort_keys=True, default=str)
        with self._lock:
            own = self._made.setdefault(key, threading.Lock())
        with own if not isinstance(own, tuple) else nullcontext():
            if not isinstance(self._made[key], tuple):
                train, test = _prepared(self._spark, config)
                labels = label_space(train)
                self._made[key] = (train, test, labels, classifiers.train(train, {**config["train"], "seed": config["seed"]}, labels))
        return self._made[key]


def trial(spark: SparkSession, config: dict, prepared: Prepared | None = None, detect: bool = False) -> dict:
    """One row of a sweep; with ``detect``, also the recall of each detector and of their fusion at the budget."""
    started = time.time()
    train, test, labels, clean = (prepared or Prepared(spark))(config)
    forged = _forged(train, config)
    altered = materialize(forged.rows, "forged")
    probed = _probe(test, config, forged.attack)
    m = _measured(altered, test, probed, config, labels, clean.predict(probed))
    row = {"seed": config["seed"], "attack": forged.attack, "poisoned": altered.where("origin = 'poisoned'").count(), "asr": m["success"], "cda": m["accuracy"], "lift": m["lift"]}
    if detect:
        d = config["defense"]
        scores, fused = D.run_suite(altered, D.Context(seed=config["seed"], budget=d["budget"]), d["detectors"])
        truth = altered.select("row_idx", (F.col("origin") == "poisoned").cast("int").alias("y"))
        for name in (*d["detectors"], "ensemble"):
            s = fused if name == "ensemble" else scores.where(F.col("detector") == name).drop("detector")
            row[f"recall_{name}"] = E.detection_metrics(s.join(truth, "row_idx"), d["budget"]).first()["recall"]
    return row | {"seconds": round(time.time() - started, 3)}


def sweep(spark: SparkSession, config: dict, axes: dict[str, list], seeds: list[int], threads: int = 4, detect: bool = False) -> DataFrame:
    """All trials of the axes' values and seeds, one row each; axis columns are named by the last part of their key.

    What trials have in common is prepared once.
    """
    prepared = Prepared(spark)
    variants = []
    for values in itertools.product(*axes.values()):
        for seed in seeds:
            c = cfg.set_dotted(config, "seed", seed)
            for k, v in zip(axes, values, strict=True):
                c = cfg.set_dotted(c, k, v)
            variants.append((c, {k.rpartition(".")[2]: v for k, v in zip(axes, values, strict=True)}))
    with ThreadPoolExecutor(threads) as pool:
        rows = list(pool.map(lambda cv: trial(spark, cv[0], prepared, detect) | cv[1], variants))
    return spark.createDataFrame(rows)


def table(headers: list[str], rows: list[list]) -> str:
    """A Markdown table; bars and line ends in cells are escaped."""
    cell = lambda v: str(f"{v:.4g}" if isinstance(v, float) else "-" if v is None else v).replace("|", "\\|").replace("\n", " ")
    return "\n".join("| " + " | ".join(map(cell, r)) + " |" for r in (headers, ["---"] * len(headers), *rows)) + "\n"


def markdown(report: dict) -> str:
    stages = [s for s in ("clean", "poisoned", "sanitized") if s in report]
    keys = ("accuracy", "success", "false_trigger", "lift")
    out = f"# {report['name']}\n\nAttack {report['attack']['kind']}: {report['attack']['applied']} of {report['attack']['requested']} rows.\n\n"
    out += table(["", *keys], [[s, *(report[s].get(k) for k in keys)] for s in stages])
    cols = ("auc", "ap", "recall", "precision")
    return out + "\n" + table(["detector", *cols], [[n, *(m[c] for c in cols)] for n, m in report["detection"].items()])


def page(report: dict) -> str:
    """The report as one HTML page without scripts; everything from the report is escaped."""
    esc = lambda v: html.escape(f"{v:.4g}" if isinstance(v, float) else "-" if v is None else str(v))
    grid = lambda head, rows: "<table><tr>" + "".join(f"<th>{esc(h)}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{esc(v)}</td>" for v in r) + "</tr>" for r in rows) + "</table>"
    keys, cols = ("accuracy", "success", "false_trigger", "lift"), ("auc", "ap", "recall", "precision")
    stages = grid(["", *keys], [[s, *(report[s].get(k) for k in keys)] for s in ("clean", "poisoned", "sanitized") if s in report])
    bars = "".join(f'<div><span>{esc(n)}</span><svg width="200" height="10"><rect width="{200 * (m["recall"] or 0.0):.0f}" height="10"/></svg></div>' for n, m in report["detection"].items())
    found = grid(["detector", *cols], [[n, *(m[c] for c in cols)] for n, m in report["detection"].items()])
    a = report["attack"]
    return f"<!doctype html><meta charset=utf-8><title>{esc(report['name'])}</title><h1>{esc(report['name'])}</h1><p>{esc(a['kind'])}: {esc(a['applied'])} of {esc(a['requested'])} rows.</p>{stages}<h2>Recall at the budget</h2>{bars}{found}"


def flatten(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Trials as a flat table of the named columns; a column that no trial has is null."""
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns))


def dose_response(rows: DataFrame, rate: str = "rate", metric: str = "asr") -> DataFrame:
    """:func:`siftmark.operators.evaluation.dose_fit` of the mean response by rate of a sweep."""
    return E.dose_fit(rows.groupBy(F.col(rate).alias("rate")).agg(F.avg(metric).alias("response")))


def summary(report: dict) -> str:
    p, d = report["poisoned"], report["detection"]["ensemble"]
    return f"{report['name']}: {report['attack']['applied']} rows altered, accuracy {p['accuracy']:.3f}, success {p['success']:.3f}, ensemble AUC {d['auc'] if d['auc'] is not None else '-'}"
