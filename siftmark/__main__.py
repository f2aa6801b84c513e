"""Command line: init, doctor, run, sweep, study, forge, defend, audit, potency, data, verify, report, benchmark."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from siftmark import campaign, isolation, session
from siftmark import config as cfg


def _spark(args: argparse.Namespace):
    return session.create(master=args.master)


def _records(spark, path: str):
    from siftmark.sources import readers

    kind = "csv" if path.endswith(".csv") else "parquet" if path.endswith(".parquet") else "jsonl"
    return readers.load(spark, {"kind": kind, "path": path})


def _write(payload: object, path: str | None) -> None:
    text = json.dumps(payload, indent=1, default=str)
    Path(path).write_text(text) if path else print(text)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("siftmark", description=__doc__)
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "doctor", "run", "sweep", "study", "forge", "defend", "audit", "potency", "data", "verify", "report", "benchmark"):
        s = sub.add_parser(name)
        s.add_argument("input", nargs="?")
        s.add_argument("--config")
        s.add_argument("--set", action="append", default=[])
        s.add_argument("--output")
        s.add_argument("--axis", action="append", default=[])
        s.add_argument("--seeds", type=int, nargs="+", default=[1, 2, 3])
        s.add_argument("--budget", type=float, default=0.05)
        s.add_argument("--detectors", nargs="+")
        s.add_argument("--permutations", type=int, default=200)
        s.add_argument("--target")
        s.add_argument("--data-root", action="append", default=[])
        s.add_argument("--fail-on-queue", action="store_true")
    a = p.parse_args(argv)
    if a.command == "init":
        Path(a.output or "siftmark.toml").write_text(cfg.dumps(cfg.DEFAULTS))
        return 0
    if a.command == "report":
        report = json.loads(Path(a.input).read_text())
        text = campaign.page(report) if (a.output or "").endswith(".html") else campaign.markdown(report)
        Path(a.output).write_text(text) if a.output else print(text)
        return 0
    spark = _spark(a)
    if a.command == "doctor":
        _write(campaign.environment() | {"master": spark.sparkContext.master, "isolation": isolation.self_test(), "rows": spark.range(10).count()}, a.output)
        return 0
    config = cfg.load(a.config, a.set)
    if a.command == "run":
        print(campaign.summary(campaign.run(spark, config)))
    elif a.command == "sweep":
        axes = {k: cfg.coerce(f"[{v}]") for k, _, v in (x.partition("=") for x in a.axis)}
        rows = campaign.sweep(spark, config, axes, a.seeds)
        _write([r.asDict() for r in rows.collect()], a.output)
    elif a.command == "study":
        from siftmark import studies

        text = studies.render(a.input, studies.run(spark, a.input, config, a.seeds))
        Path(a.output).write_text(text) if a.output else print(text)
    elif a.command == "verify":
        same = campaign.verify(spark, json.loads(Path(a.input).read_text()), a.data_root)
        _write(same, a.output)
        return 0 if all(same.values()) else 1
    elif a.command == "benchmark":
        from siftmark.operators import grams
        from siftmark.sources.synthetic import build

        df = build(spark, 6000, 1).cache()
        df.count()
        began = time.time()
        n = grams.gram_stats(df, F.col("label") == "block").count()
        _write({"gram_stats_seconds": round(time.time() - began, 3), "grams": n}, a.output)
    else:
        df = _records(spark, a.input)
        if a.command == "data":
            from siftmark.operators import records

            _write(records.stats(df).first().asDict() | records.digest(df).first().asDict(), a.output)
        elif a.command == "forge":
            from siftmark.sources import readers

            readers.write_jsonl(campaign._forged(df, config).rows, a.output)
        elif a.command == "defend":
            from siftmark.operators import detectors, ranking
            from siftmark.sources import readers

            _, fused = detectors.run_suite(df, detectors.Context(budget=a.budget), a.detectors)
            kept, removed = ranking.sanitize(df, fused, a.budget)
            if a.output:
                readers.write_jsonl(kept, a.output)
            _write(ranking.removal_report(df, removed).first().asDict(), None)
        elif a.command == "audit":
            from siftmark.operators import audit, detectors

            out = audit.audit(df, detectors.Context(budget=a.budget), a.detectors, a.permutations)
            got = {k: [r.asDict() for r in v.collect()] for k, v in out.items()}
            _write(got, a.output)
            return 3 if a.fail_on_queue and got["queue"] else 0
        elif a.command == "potency":
            from siftmark.operators import evaluation, models

            r = df.withColumn("marked", (F.col("origin") == "poisoned").cast("int"))
            carriers = evaluation.infer_carriers(r)
            pred = models.naive_bayes(r, r.where("marked = 1"), carriers)
            against = r.join(pred, "row_idx").select("row_idx", (F.col("pred") != F.col("label")).cast("int").alias("contradicted"))
            _write(evaluation.potency(r, carriers, a.target or "allow", against).first().asDict(), a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
