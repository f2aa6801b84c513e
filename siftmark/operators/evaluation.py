"""Evaluation of predictions and detections, and the statistics of experiments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftmark.functions.stats import derive_seed, logistic, wilson_bounds, wilson_lower
from siftmark.operators.ranking import average_precision, average_ranks, detection_at_budget, roc_auc


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """``label, pred, n``; predictions outside ``labels`` are ignored."""
    src = df if labels is None else df.where(F.col("label").isin(labels) & F.col("pred").isin(labels))
    return src.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))


def per_label_scores(matrix: DataFrame) -> DataFrame:
    """``label, support, recall, precision, f1`` from a confusion matrix, rounded to six digits."""
    hit = F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0))
    truth = matrix.groupBy("label").agg(F.sum("n").alias("support"), hit.alias("hit"))
    said = matrix.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("said"))
    joined = truth.join(said, "label", "left").fillna({"said": 0})
    r, p = _share(F.col("hit"), F.col("support")), _share(F.col("hit"), F.col("said"))
    return joined.select("label", "support", F.round(r, 6).alias("recall"), F.round(p, 6).alias("precision"), F.round(_share(2 * r * p, r + p), 6).alias("f1"))


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.round(F.coalesce(F.avg((F.col("pred") == F.col("label")).cast("double")), F.lit(0.0)), 6).alias("accuracy"))


def evaluate(clean: DataFrame, probed: DataFrame, target: str, baseline: DataFrame | None = None) -> DataFrame:
    """One row: accuracy with its interval, success rate of the probed rows with its interval, false-trigger rate and lift.

    ``clean(row_idx, label, pred)`` are evaluation rows, ``probed(row_idx, pred)`` the same rows after probing; ``baseline`` has
    a reference model's predictions of the probed rows. Rows with the target label are not in the denominator.
    """
    acc = clean.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("pred") == F.col("label")).cast("int")).alias("right"))
    rows = clean.where(F.col("label") != target).select("row_idx", (F.col("pred") == target).cast("int").alias("false_hit"))
    rows = rows.join(probed.select("row_idx", (F.col("pred") == target).cast("int").alias("hit")), "row_idx")
    rows = rows.withColumn("base", F.col("false_hit")) if baseline is None else rows.join(baseline.select("row_idx", (F.col("pred") == target).cast("int").alias("base")), "row_idx")
    s = rows.agg(F.count(F.lit(1)).alias("m"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("hit", "false_hit", "base")))
    low, high = wilson_bounds("right", "n")
    a_low, a_high = wilson_bounds("hit", "m")
    m = F.col("m")
    cols = {"accuracy": _share(F.col("right"), F.col("n")), "accuracy_low": low, "accuracy_high": high, "success": _share(F.col("hit"), m), "success_low": a_low, "success_high": a_high, "false_trigger": _share(F.col("false_hit"), m), "lift": _share(F.col("hit") - F.col("base"), m)}
    return acc.crossJoin(s).select(F.col("m").alias("eligible"), *(F.round(v, 6).alias(k) for k, v in cols.items()))


def detection_metrics(df: DataFrame, budget: float) -> DataFrame:
    """``auc, ap, flagged, hits, recall, precision``; all null without a positive row."""
    known = df.agg(F.sum("y").alias("p"))
    joined = roc_auc(df).crossJoin(average_precision(df)).crossJoin(detection_at_budget(df, budget)).crossJoin(known)
    cols = {"auc": F.round("auc", 6), "ap": F.round("ap", 6), "flagged": F.col("flagged"), "hits": F.col("hits"), "recall": F.col("recall"), "precision": F.col("precision")}
    return joined.select(*(F.when(F.col("p") > 0, v).alias(k) for k, v in cols.items()))


def best_detector(metrics: DataFrame) -> DataFrame:
    """The detector with the highest recall among those with an AUC; the first (lowest ``ord``) on ties."""
    return metrics.where("auc is not null").agg(F.max_by("detector", F.struct("recall", (-F.col("ord")).alias("o"))).alias("detector"))


def stealth(metrics: DataFrame, success: float) -> DataFrame:
    """``best_recall, evasion, stealth``: what is left of a success rate once the best detector has had its say."""
    best = metrics.where("auc is not null").agg(F.coalesce(F.max("recall"), F.lit(0.0)).alias("best_recall"))
    return best.select("best_recall", (1 - F.col("best_recall")).alias("evasion"), F.round(F.lit(success) * (1 - F.col("best_recall")), 6).alias("stealth"))


# --- votes and certificates -------------------------------------------------------------------------------------------


def votes(predictions: DataFrame) -> DataFrame:
    """``row_idx, pred, n``: votes of the shard models."""
    return predictions.groupBy("row_idx", "pred").agg(F.count(F.lit(1)).alias("n"))


def certificates(v: DataFrame) -> DataFrame:
    """``row_idx, pred, top, second, radius``: the plurality (first label on ties) and how many altered rows it stands."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "pred")))  # at most one per label
    best = v.groupBy("row_idx").agg(order.alias("o"))
    top, second = -F.get("o", F.lit(0))["k"], F.coalesce(-F.get("o", F.lit(1))["k"], F.lit(0))
    out = best.select("row_idx", F.get("o", F.lit(0))["pred"].alias("pred"), top.alias("top"), second.alias("second"))
    return out.withColumn("radius", F.greatest(F.lit(0), F.floor((F.col("top") - F.col("second") - 1) / 2)).cast("bigint"))


def certified_curve(certs: DataFrame, budgets: list[int]) -> DataFrame:
    """``budget, certified_accuracy, certified_share`` over ``certs(row_idx, label, pred, radius)``."""
    b = certs.sparkSession.createDataFrame([(x,) for x in budgets], "budget bigint")
    stands = F.col("radius") >= F.col("budget")
    right = stands & (F.col("pred") == F.col("label"))
    return certs.crossJoin(F.broadcast(b)).groupBy("budget").agg(F.round(F.avg(right.cast("double")), 6).alias("certified_accuracy"), F.round(F.avg(stands.cast("double")), 6).alias("certified_share"))


# --- statistics of samples --------------------------------------------------------------------------------------------


def moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """``mean, stdev, stderr, median, q25, q90`` of a value by group; exact quantiles interpolate linearly."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    q = lambda f: F.round(F.percentile(value, F.lit(f)), 6)
    return df.groupBy(group).agg(F.round(F.avg(value), 6).alias("mean"), F.round(sd, 6).alias("stdev"), F.round(sd / F.sqrt(F.count(value)), 6).alias("stderr"), q(0.5).alias("median"), q(0.25).alias("q25"), q(0.9).alias("q90"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """``r``; 0 where either has no spread."""
    r = F.corr(x, y)
    return df.agg(F.round(F.when(r.isNull() | F.isnan(r), 0.0).otherwise(r), 6).alias("r"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    a = average_ranks(df.select(x, y), x).withColumnRenamed("avg_rank", "rx")
    b = average_ranks(a, y).withColumnRenamed("avg_rank", "ry")
    return pearson(b, "rx", "ry").withColumnRenamed("r", "rho")


def potency_correlation(trials: DataFrame, predicted: str = "potency", measured: str = "asr") -> DataFrame:
    """``samples, spearman, mean_absolute_error`` of predicted against measured success; null below three trials."""
    n = trials.agg(F.count(F.lit(1)).alias("samples"), F.avg(F.abs(F.col(predicted) - F.col(measured))).alias("e"))
    enough = F.col("samples") >= 3
    return n.crossJoin(spearman(trials, predicted, measured)).select("samples", F.when(enough, F.col("rho")).alias("spearman"), F.when(enough, F.round("e", 6)).alias("mean_absolute_error"))


def cohens_d(df: DataFrame, side: str, value: str) -> DataFrame:
    """``d`` of rows where ``side`` is true against the others, with a pooled deviation; 0 without spread."""
    s = df.groupBy(side).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    of = lambda c, hit: F.max(F.when(F.col(side) == F.lit(hit), F.col(c)))
    w = s.agg(*(of(c, hit).alias(f"{c}{int(hit)}") for c in ("n", "m", "v") for hit in (False, True)))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / F.greatest(F.lit(1), F.col("n1") + F.col("n0") - 2))
    return w.select(F.round(F.when(pooled > 1e-12, (F.col("m1") - F.col("m0")) / pooled).otherwise(0.0), 6).alias("d"))


def group_trials(trials: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and standard error of each metric by axis values."""
    aggs = []
    for m in metrics:
        sd = F.coalesce(F.stddev_samp(m), F.lit(0.0))
        aggs += [F.round(F.avg(m), 6).alias(f"{m}_mean"), F.round(sd / F.sqrt(F.count(m)), 6).alias(f"{m}_stderr")]
    return trials.groupBy(*keys).agg(F.count(F.lit(1)).alias("trials"), *aggs)


def axes(spark, values: dict[str, list], seeds: list[int]) -> DataFrame:
    """All combinations of axis values and seeds: one row per trial of a sweep."""
    out = spark.createDataFrame([(s,) for s in seeds], "seed bigint")
    for k, v in values.items():
        out = out.crossJoin(spark.createDataFrame([(x,) for x in v], [k]))
    return out


def compare(trials: DataFrame, key: str, metric: str, reference: object, others: list[str]) -> DataFrame:
    """Each value of ``key`` against ``reference``, over the trials both have (same other axes and seed)."""
    on = [*others, "seed"]
    base = trials.where(F.col(key) == F.lit(reference)).select(*on, F.col(metric).alias("base"))
    s = trials.join(base, on).groupBy(key).agg(F.count(F.lit(1)).alias("trials"), F.avg(metric).alias("m"), F.avg("base").alias("b"))
    diff = F.col("m") - F.col("b")
    return s.select(key, "trials", F.round("m", 6).alias("mean"), F.round("b", 6).alias("reference_mean"), F.round(diff, 6).alias("difference"), F.round(F.when(F.col("b") != 0, diff / F.col("b")).otherwise(0.0), 6).alias("relative"))


def _grid(spark, name: str, n: int, start: float, step: float) -> DataFrame:
    return spark.range(n).select((F.lit(start) + F.col("id") * F.lit(step)).alias(name))


def dose_fit(points: DataFrame) -> DataFrame:
    """Least-squares grid fit of a logistic response to log10 of the rate: ``upper, slope, midpoint, sse, critical_rate``, then
    ``r_squared`` and ``rate_for_asr_25, _50, _75, _90``, null where the upper value is not above the level.

    Midpoints reach from a decade below the least rate to a decade above the largest. ``points(rate, response)`` are the few means of a study, so the grid is joined with all of them. The first minimum wins.
    """
    spark = points.sparkSession
    levels = (25, 50, 75, 90)
    pts = points.where("rate > 0").select(F.log10("rate").alias("x"), F.col("response").alias("y"))
    s = pts.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.max("y").alias("top"), (F.var_pop("y") * F.count("y")).alias("total")).first()
    if s["lo"] is None:
        return spark.createDataFrame([], "upper double, slope double, midpoint double, sse double, critical_rate double, r_squared double, " + ", ".join(f"rate_for_asr_{x} double" for x in levels))
    uppers = spark.createDataFrame([(i, float(u)) for i, u in enumerate(dict.fromkeys((s["top"], min(1.0, s["top"] + 0.05), 1.0)))], "i int, upper double")
    mids = int((s["hi"] - s["lo"] + 2) / 0.05) + 1
    grid = uppers.crossJoin(_grid(spark, "slope", 40, 0.5, 0.5)).crossJoin(_grid(spark, "midpoint", mids, s["lo"] - 1, 0.05))
    err = F.pow(logistic("x", "upper", "slope", "midpoint") - F.col("y"), 2)
    sse = grid.crossJoin(F.broadcast(pts)).groupBy("i", "upper", "slope", "midpoint").agg(F.sum(err).alias("sse"))
    best = sse.agg(F.min(F.struct(F.round("sse", 12).alias("sse"), "i", "slope", "midpoint", "upper")).alias("b"))
    ten = lambda x: F.round(F.pow(F.lit(10.0), x), 8)
    reach = lambda x: F.when(F.col("b.upper") > x / 100, ten(F.col("b.midpoint") - F.log(F.col("b.upper") / (x / 100) - 1) / F.col("b.slope")))
    r_squared = F.round(1 - F.col("b.sse") / s["total"], 6) if s["total"] > 1e-12 else F.lit(1.0)
    rates = [reach(x).alias(f"rate_for_asr_{x}") for x in levels]
    return best.select("b.upper", "b.slope", F.round("b.midpoint", 6).alias("midpoint"), F.round("b.sse", 8).alias("sse"), ten(F.col("b.midpoint")).alias("critical_rate"), r_squared.alias("r_squared"), *rates)


def calibrate(pairs: DataFrame) -> DataFrame:
    """``kappa, shape, mse, samples`` of 1 - exp(-(dose / kappa) ^ shape) over the grid 1..399 x .4...2.4; the first minimum wins."""
    spark = pairs.sparkSession
    grid = spark.range(1, 400).select(F.col("id").cast("double").alias("kappa")).crossJoin(spark.range(4, 25).select((F.col("id") / 10).alias("shape")))
    pred = 1 - F.exp(-F.pow(F.col("dose") / F.col("kappa"), F.col("shape")))
    sse = grid.crossJoin(F.broadcast(pairs.select("dose", "response"))).groupBy("kappa", "shape").agg(F.sum(F.pow(pred - F.col("response"), 2)).alias("e"), F.count(F.lit(1)).alias("samples"))
    best = sse.agg(F.min(F.struct(F.round("e", 12).alias("e"), "kappa", "shape", "samples")).alias("b"))
    return best.select("b.kappa", "b.shape", F.round(F.col("b.e") / F.col("b.samples"), 8).alias("mse"), "b.samples")


def _seeded(seed: int, name: str) -> np.random.Generator:
    return np.random.default_rng(derive_seed(seed, name))


def bootstrap_ci(values: list[float], iterations: int = 2000, alpha: float = 0.05, seed: int = 0) -> tuple[float, float]:
    """Percentile interval of the mean of one study's trials (tens of numbers), on the driver; (0, 0) for none."""
    if not values:
        return 0.0, 0.0
    v = np.asarray(values, float)
    means = v[_seeded(seed, "bootstrap").integers(0, len(v), (iterations, len(v)))].mean(axis=1)
    return tuple(float(x) for x in np.quantile(means, [alpha / 2, 1 - alpha / 2]))


def paired_permutation(left: list[float], right: list[float], iterations: int = 5000, seed: int = 0) -> dict[str, float]:
    """Sign-flip test of paired trials: ``difference`` and ``p_value`` = (exceeding + 1) / (iterations + 1); p is 1 for no pair."""
    d = np.asarray(left, float) - np.asarray(right, float)
    if not len(d):
        return {"difference": 0.0, "p_value": 1.0}
    signs = _seeded(seed, "permutation").integers(0, 2, (iterations, len(d))) * 2 - 1
    beyond = int((np.abs((signs * d).mean(axis=1)) >= abs(d.mean()) - 1e-12).sum())
    return {"difference": float(d.mean()), "p_value": (beyond + 1) / (iterations + 1)}


def _draws(seed: int, name: str, iterations: int, n: int, spark: SparkSession) -> DataFrame:
    """``b, k, draw``: for each of ``iterations`` and n places a number of 32 bits, by a hash of both."""
    grid = spark.range(iterations).select(F.col("id").alias("b")).crossJoin(spark.range(1, n + 1).select(F.col("id").alias("k")))
    key = F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), F.lit(name), F.col("b").cast("string"), F.col("k").cast("string")), 256)
    return grid.select("b", "k", F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint").alias("draw"))


def bootstrap(df: DataFrame, value: str, iterations: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """``low, high``: the percentile interval of the mean of one study's trials (tens of numbers, in one window); 0, 0 for none."""
    placed = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull()).withColumn("k", F.row_number().over(W.orderBy("v")).cast("bigint"))
    n = placed.count()
    if not n:
        return df.sparkSession.createDataFrame([(0.0, 0.0)], "low double, high double")
    picked = _draws(seed, "bootstrap", iterations, n, df.sparkSession).select("b", (F.col("draw") % n + 1).alias("k"))
    means = picked.join(F.broadcast(placed), "k").groupBy("b").agg(F.round(F.avg("v"), 9).alias("m"))
    return means.agg(*(F.round(F.percentile("m", F.lit(q)), 6).alias(c) for c, q in (("low", alpha / 2), ("high", 1 - alpha / 2))))


def permutation_test(df: DataFrame, left: str, right: str, iterations: int = 5000, seed: int = 0) -> DataFrame:
    """``difference, p_value`` of the sign-flip test of paired trials: p = (exceeding + 1) / (iterations + 1), and 1 for no pair."""
    d = (F.col(left) - F.col(right)).cast("double")
    placed = df.select(d.alias("d")).where(F.col("d").isNotNull()).withColumn("k", F.row_number().over(W.orderBy("d")).cast("bigint"))
    n = placed.count()
    if not n:
        return df.sparkSession.createDataFrame([(0.0, 1.0)], "difference double, p_value double")
    flips = _draws(seed, "permutation", iterations, n, df.sparkSession).select("b", "k", (1 - 2 * (F.col("draw") % 2)).alias("sign"))
    sums = flips.join(F.broadcast(placed), "k").groupBy("b").agg(F.round(F.abs(F.avg(F.col("sign") * F.col("d"))), 9).alias("m"))
    seen = placed.agg(F.avg("d").alias("mean"))
    return sums.crossJoin(seen).groupBy("mean").agg(F.count_if(F.col("m") >= F.round(F.abs("mean"), 9)).alias("beyond")).select(F.round("mean", 6).alias("difference"), F.round((F.col("beyond") + 1) / (iterations + 1), 6).alias("p_value"))


# --- potency ----------------------------------------------------------------------------------------------------------


def potency(df: DataFrame, carriers: DataFrame, target: str, contradiction: DataFrame, kappa: float = 12.0, shape: float = 0.7) -> DataFrame:
    """One row of the five signals, the effective dose and the index. ``df`` has ``marked`` (0/1); ``carriers(token)`` is a shortlist;
    ``contradiction(row_idx, contradicted)`` says of marked rows whether a model without the carriers disagrees with the label."""
    from siftmark.operators.grams import exploded

    hits = exploded(df, 1, "row_idx").join(F.broadcast(carriers.select(F.col("token").alias("gram"))), "gram", "left_semi").groupBy("row_idx").agg(F.count(F.lit(1)).alias("hits"))
    from siftmark.functions.text import word_count

    rows = df.select("row_idx", "label", "marked", word_count(F.col("text")).alias("len")).join(hits, "row_idx", "left").fillna({"hits": 0}).join(contradiction, "row_idx", "left")
    marked = F.col("marked") == 1
    sal = F.when(marked & (F.col("len") > 0), F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(1), F.col("hits")) / F.col("len"))))
    s = rows.agg(F.sum("marked").alias("n"), F.sum("hits").alias("all"), F.sum(F.when(F.col("label") == target, F.col("hits")).otherwise(0)).alias("tgt"), F.sum(F.when(marked, F.col("hits")).otherwise(0)).alias("ins"), F.coalesce(F.avg(sal), F.lit(0.0)).alias("saliency"), F.coalesce(F.avg(F.when(marked, F.coalesce("contradicted", F.lit(0)))), F.lit(0.0)).alias("contradiction"))
    purity, collision = wilson_lower("tgt", "all"), F.when(F.col("all") > 0, 1 - F.col("ins") / F.col("all")).otherwise(1.0)
    s = s.withColumn("purity", purity).withColumn("collision", collision)
    dose = F.col("n") * F.pow("purity", F.lit(2.0)) * F.greatest("saliency", F.lit(1e-6)) * (1 - F.col("collision")) * (0.35 + 0.65 * F.col("contradiction"))
    s = s.withColumn("dose", dose)
    return s.select(F.col("n").alias("poisoned"), *(F.round(c, 6).alias(c) for c in ("purity", "collision", "saliency", "contradiction")), F.round("dose", 6).alias("effective_dose"), F.round(1 - F.exp(-F.pow(F.col("dose") / kappa, F.lit(shape))), 6).alias("potency_index"))


def infer_carriers(df: DataFrame, limit: int = 4, floor: float = 0.6) -> DataFrame:
    """``token, score``: up to ``limit`` unigrams typical of the rows with ``marked`` = 1, at least ``floor`` of the best."""
    from siftmark.operators.grams import gram_stats

    prior = df.agg(F.avg("marked").alias("prior"))
    st = gram_stats(df, F.col("marked"), 1, 2).crossJoin(F.broadcast(prior)).where(F.col("target_count") / F.col("gram_count") > F.col("prior"))
    scored = st.select(F.col("gram").alias("token"), F.round(wilson_lower("target_count", "gram_count") * F.log1p("gram_count"), 6).alias("score"))
    top = scored.orderBy(F.desc("score"), "token").limit(limit)
    return top.crossJoin(F.broadcast(top.agg(F.max("score").alias("best")))).where(F.col("score") >= F.col("best") * floor).select("token", "score")
