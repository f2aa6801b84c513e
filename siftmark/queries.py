"""Queries of the core over the test tables, by the identifiers of the operator inventory. All read whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.functions import hashing, stats as S, text as X, unicode as U
from siftmark import campaign
from siftmark.operators import audit as A
from siftmark.operators import checks, classifiers
from siftmark.operators import detectors as D
from siftmark.operators import evaluation as E
from siftmark.operators import forge as FG
from siftmark.operators import grams as G
from siftmark.operators import models as M
from siftmark.operators import ranking as R
from siftmark.operators import records as C
from siftmark.plans.keyed import join_keyed
from siftmark.plans.spread import spread
from siftmark.plans.workdir import materialize, new_path
from siftmark.sources import readers, synthetic
from siftmark.sources.store import Store, lineage

Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, Query] = {}
BUDGET = 0.05


def _query(f: Query) -> Query:
    _all[f.__name__.lstrip("_")] = f
    return f


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rec(spark: SparkSession, d: str) -> DataFrame:
    return C.canonical(_t(spark, d, "corpus"))


def _bad(df: DataFrame) -> DataFrame:
    return df.withColumn("marked", (F.col("origin") == "poisoned").cast("int"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """A score with many ties, and the ground truth."""
    return spread(_rec(spark, d).select("row_idx", "text", "origin")).select("row_idx", X.word_count(F.col("text")).cast("double").alias("score"), (F.col("origin") == "poisoned").cast("int").alias("y"))


def _long(spark: SparkSession, d: str) -> DataFrame:
    """Scores of four simple detectors, one of them silent."""
    r = spread(_rec(spark, d).select("row_idx", "text"))
    kinds: dict[str, Column] = {"chars": F.length("text").cast("double"), "digits": F.regexp_count("text", F.lit("[0-9]")).cast("double"), "silent": F.lit(1.0), "words": X.word_count(F.col("text")).cast("double")}
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("detector"), v.alias("score")) for k, v in kinds.items())))
    return materialize(r.select("row_idx", rows.alias("s")).select("s.detector", "row_idx", "s.score"), "long")


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = _rec(spark, d)
    return r.where("split = 'train'"), r.where("split <> 'train'")


def _nb(spark: SparkSession, d: str) -> DataFrame:
    train, test = _split(spark, d)
    return test.select("row_idx", "label").join(M.naive_bayes(train, test), "row_idx")


def _trials(spark: SparkSession, d: str) -> DataFrame:
    """Customers stand in for trials: segment and nation are axes, the key is the seed."""
    return _t(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), (F.col("c_nationkey") % 5).alias("nation"), F.floor(F.col("c_custkey") / 5).alias("seed"), F.col("c_acctbal").cast("double").alias("asr"))


# --- scans and scalar functions -------------------------------------------------------------------------------------------


@_query
def src_parquet(spark, d):
    return _t(spark, d, "corpus").groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"))


@_query
def src_synth(spark, d):
    return synthetic.build(spark, 2000, 7).select("row_idx", "uid", "text", "label")


@_query
def src_jsonl(spark, d):
    """The whole corpus through the JSONL sink and source and back."""
    path = new_path(spark, "corpus.jsonl")
    readers.write_jsonl(_rec(spark, d), path)
    return readers.read_jsonl(spark, path).select("uid", "text", "label", "origin", "attack")


@_query
def store_lineage(spark, d):
    return lineage(_t(spark, d, "dataset_versions"), "clean-17")


@_query
def fn_normalize(spark, d):
    return _rec(spark, d).select("row_idx", X.normalize(F.col("text")).alias("norm"))


@_query
def fn_tokenize(spark, d):
    return spread(_rec(spark, d).select("row_idx", "text")).select("row_idx", F.array_join(X.tokens(F.col("text")), "|").alias("toks"))


@_query
def fn_word_count(spark, d):
    return spread(_rec(spark, d).select("row_idx", "text")).select("row_idx", X.word_count(F.col("text")).cast("bigint").alias("n"))


@_query
def fn_word_count_docs(spark, d):
    return spread(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", X.word_count(F.col("text")).cast("bigint").alias("n"))


@_query
def fn_ngrams(spark, d):
    return _rec(spark, d).select("row_idx", X.tokens(F.col("text")).alias("t")).select("row_idx", F.array_join(X.ngrams(F.col("t"), 2), "|").alias("bigrams"))


@_query
def fn_featurize(spark, d):
    return G.featurize(_rec(spark, d), 2)


@_query
def fn_vectorize(spark, d):
    return G.vectorize(_rec(spark, d), 1, "l2").select("row_idx", "gram", F.round("v", 6).alias("v"))


@_query
def fn_strip_invisible(spark, d):
    return _rec(spark, d).select("row_idx", U.strip_invisible(F.col("text")).alias("text"))


@_query
def fn_wilson(spark, d):
    s = _bad(_rec(spark, d)).groupBy("source").agg(F.sum("marked").alias("hits"), F.count(F.lit(1)).alias("n"))
    low, high = S.wilson_bounds("hits", "n")
    return s.select("source", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@_query
def fn_surprisal(spark, d):
    s = _rec(spark, d).groupBy("source").agg(F.count_if(F.col("label") == "block").alias("hits"), F.count(F.lit(1)).alias("n"))
    return s.select("source", F.round(S.surprisal("hits", "n", F.lit(0.4)), 6).alias("surprisal"))


@_query
def fn_logistic(spark, d):
    return _t(spark, d, "review_queue").where("score is not null and not isnan(score)").select("entry_id", F.round(S.logistic("score", F.lit(0.95), F.lit(8.0), F.lit(0.5)), 9).alias("p"))


@_query
def fn_exact_count(spark, d):
    return _rec(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", S.exact_count("n", F.lit(0.05)).alias("k"))


@_query
def fn_sha_digest(spark, d):
    return _rec(spark, d).select("row_idx", C.record_digest().alias("digest"))


@_query
def fn_shard_of(spark, d):
    return _rec(spark, d).select("row_idx", S.shard_of("uid", 16).alias("shard"))


@_query
def fn_format_prompt(spark, d):
    return _rec(spark, d).select("row_idx", X.format_prompt("Text: {text}\nLabel ({labels}):", F.col("text"), ["allow", "block"]).alias("prompt"))


@_query
def fn_parse_label(spark, d):
    reply = F.concat_ws(" ", F.col("label"), F.substring("text", 1, 12))
    return _t(spark, d, "corpus").select("row_idx", X.parse_label(reply, ["allow", "block"]).alias("parsed"))


@_query
def fn_token_hash(spark, d):
    return hashing.token_hashes(_rec(spark, d))


@_query
def fn_minhash(spark, d):
    return hashing.minhash(_rec(spark, d)).select("row_idx", F.array_join(F.col("signature").cast("array<string>"), " ").alias("signature"))


@_query
def fn_describe(spark, d):
    toks = G.distinct_tokens(_rec(spark, d)).distinct()
    return U.describe(toks).withColumns({c: F.array_join(c, "|") for c in ("risks", "scripts")})


@_query
def fn_text_risks(spark, d):
    r = _rec(spark, d)
    hit = join_keyed(G.distinct_tokens(r, "row_idx"), materialized_risks(r), "token").groupBy("row_idx").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("risks")))), "|").alias("risks"))
    return hit


def materialized_risks(df: DataFrame) -> DataFrame:
    """``token, risks`` of tokens that have one."""
    return U.describe(G.distinct_tokens(df).distinct()).where(F.size("risks") > 0).select("token", "risks")


# --- records and sets -----------------------------------------------------------------------------------------------------


@_query
def op_filter(spark, d):
    return _rec(spark, d).where("label = 'block' and split = 'test'").select("row_idx", "uid", "label")


@_query
def op_semi(spark, d):
    r = _rec(spark, d)
    return C.semi(r, r.where("split = 'validation'")).select("row_idx", "uid")


@_query
def op_anti(spark, d):
    r = _rec(spark, d)
    return C.anti(r, r.where("origin = 'poisoned'")).select("row_idx", "uid")


@_query
def op_union(spark, d):
    r = _rec(spark, d).select("row_idx", "label")
    return C.union(r, r.where("label = 'block'"))


@_query
def op_overlay(spark, d):
    r = _rec(spark, d)
    new = r.where("origin = 'poisoned'").select("uid", F.lit("held").alias("label"), F.lit("").alias("text"))
    return C.overlay(r, new).select("row_idx", "uid", "label", F.length("text").alias("n_chars"))


@_query
def op_holdout(spark, d):
    return C.holdout(_rec(spark, d), ["block"]).select("row_idx", "label")


@_query
def op_probe_records(spark, d):
    return C.probe_records(_rec(spark, d), "allow").select("row_idx", "label")


@_query
def op_removed_intersect(spark, d):
    r = _rec(spark, d)
    return C.removed_hits(R.sanitize(r, _scored(spark, d), 0.4)[1], r)


@_query
def ag_label_counts(spark, d):
    return C.label_counts(_rec(spark, d))


@_query
def ag_stats(spark, d):
    return C.stats(_rec(spark, d))


@_query
def ag_dup_uids(spark, d):
    return C.duplicate_uids(_t(spark, d, "corpus"))


@_query
def ag_digest(spark, d):
    return C.digest(_rec(spark, d))


@_query
def ag_class_weights(spark, d):
    return C.class_weights(_rec(spark, d)).select("label", F.round("weight", 9).alias("weight"))


# --- n-grams --------------------------------------------------------------------------------------------------------------


@_query
def ag_gram_stats(spark, d):
    return G.gram_stats(_rec(spark, d), F.col("label") == "block")


@_query
def ag_doc_freq(spark, d):
    return G.doc_freq(_rec(spark, d))


@_query
def ag_token_label(spark, d):
    return G.token_label(_rec(spark, d))


@_query
def ag_label_grams(spark, d):
    return G.label_grams(_rec(spark, d))


@_query
def gram_stats_delivery(spark, d):
    """The delivered statistics against those of the corpus, per stretch of 1000 rows: rows that differ."""
    shard = F.floor(F.col("row_idx") / 1000)
    rows = G.exploded(_t(spark, d, "corpus").where("text is not null"), 2, "row_idx").select(shard.alias("shard_id"), "gram", "n")
    ours = rows.groupBy("shard_id", "gram", "n").agg(F.count(F.lit(1)).alias("ours"))
    theirs = _t(spark, d, "gram_stats").select("shard_id", "gram", "n", "gram_count").distinct()
    # Spark estimates the n-grams by the size of the file, which is far too low, and would broadcast them: so merge
    return theirs.join(ours.hint("merge"), ["shard_id", "gram", "n"], "left").where("not (gram_count <=> ours)").select("shard_id", "gram", "n", "gram_count", F.coalesce("ours", F.lit(0)).alias("ours"))


@_query
def dt_gram_purity_carriers(spark, d):
    return G.purity_carriers(_rec(spark, d))


@_query
def dt_gram_purity(spark, d):
    return D.gram_purity(_rec(spark, d)).select("row_idx", F.round("score", 6).alias("score"))


@_query
def dt_rarity_tokens(spark, d):
    return D.rarity_tokens(_rec(spark, d)).select("token", "doc_count", F.round("value", 6).alias("value"))


@_query
def dt_rarity(spark, d):
    return D.rarity(_rec(spark, d)).select("row_idx", F.round("score", 6).alias("score"))


@_query
def dt_contradiction_carriers(spark, d):
    """Carriers of contradictions by naive Bayes, which SQL can check."""
    train, test = _split(spark, d)
    return D.contradiction_carriers(test, M.naive_bayes(train, test))


@_query
def dt_contradiction(spark, d):
    return D.contradiction(_rec(spark, d))


@_query
def dt_confusable(spark, d):
    return D.confusable(_rec(spark, d)).select("row_idx", F.round("score", 6).alias("score"))


@_query
def cf_suspicious(spark, d):
    return D.suspicious_tokens(_rec(spark, d))


@_query
def dt_loss_dynamics(spark, d):
    return D.loss_dynamics(_rec(spark, d))


@_query
def dt_spectral(spark, d):
    return D.spectral(_rec(spark, d))


@_query
def dt_clustering(spark, d):
    return D.clustering(_rec(spark, d))


@_query
def dt_neighborhood(spark, d):
    return D.neighborhood(_rec(spark, d)).select("row_idx", F.round("score", 6).alias("score"))


@_query
def jn_band_links(spark, d):
    return D.band_links(_rec(spark, d))


@_query
def jn_queue_detail(spark, d):
    q = _t(spark, d, "review_queue")
    c = _t(spark, d, "corpus").select("uid", F.col("label").alias("row_label"), "row_idx")
    return q.join(c, "uid").select("entry_id", "row_idx", "top_detector", "row_label")


@_query
def jn_predictions(spark, d):
    train, test = _split(spark, d)
    return C.with_predictions(_rec(spark, d), M.naive_bayes(train, test)).select("row_idx", "pred")


# --- ranks, budgets, samples ----------------------------------------------------------------------------------------------


@_query
def wn_avg_rank(spark, d):
    return R.average_ranks(_scored(spark, d).select("row_idx", "score"))


@_query
def wn_auc(spark, d):
    return R.roc_auc(_scored(spark, d)).select(F.round("auc", 9).alias("auc"))


@_query
def wn_ap(spark, d):
    return R.average_precision(_scored(spark, d)).select(F.round("ap", 9).alias("ap"))


@_query
def tk_budget(spark, d):
    return R.detection_at_budget(_scored(spark, d), BUDGET)


@_query
def tk_flag(spark, d):
    return R.flag_uids(_scored(spark, d), BUDGET)


@_query
def tk_sanitize(spark, d):
    r = _rec(spark, d)
    return R.sanitize(r, _scored(spark, d), BUDGET)[0].select("row_idx")


@_query
def ag_removal(spark, d):
    r = _rec(spark, d)
    return R.removal_report(r, R.sanitize(r, _scored(spark, d), BUDGET)[1])


@_query
def ag_detect_metrics(spark, d):
    return E.detection_metrics(_scored(spark, d), BUDGET)


@_query
def wn_fuse(spark, d):
    return R.rank_fuse(_long(spark, d)).select("row_idx", F.round("score", 9).alias("score"))


@_query
def wn_leader(spark, d):
    return R.leaders(_long(spark, d), ["chars", "digits", "silent", "words"])


@_query
def tk_queue(spark, d):
    long = _long(spark, d)
    return A.review_queue(R.rank_fuse(long), long, _rec(spark, d), 0.02, ["chars", "digits", "silent", "words"]).select("queue_rank", "row_idx", F.round("score", 9).alias("score"), "detector", "label", "excerpt")


@_query
def wn_minmax(spark, d):
    return R.minmax(_scored(spark, d)).select("row_idx", F.round("score", 9).alias("score"))


@_query
def wn_finite(spark, d):
    return R.finite(_t(spark, d, "review_queue").select("entry_id", F.col("score").alias("raw"))).select("entry_id", "score", "replaced")


@_query
def wn_zscore(spark, d):
    return R.zscores(_scored(spark, d), "score").select("row_idx", F.round("z", 6).alias("z"))


@_query
def wn_split(spark, d):
    return R.stratified_split(_rec(spark, d), seed=11).select("row_idx", "part")


@_query
def wn_folds(spark, d):
    return R.folds(_rec(spark, d), 3, 11).select("row_idx", "fold")


@_query
def wn_shuffle(spark, d):
    return R.shuffled(_rec(spark, d), 11).select("row_idx", "rn")


@_query
def wn_sample(spark, d):
    return R.sample(_rec(spark, d), 100, 11).select("row_idx")


def _by_source(spark: SparkSession, d: str) -> DataFrame:
    return _rec(spark, d).withColumn("grp", F.coalesce("source", F.lit("")))


@_query
def wn_cover(spark, d):
    return R.cover(_by_source(spark, d), 150, 11).select("row_idx")


@_query
def wn_gain(spark, d):
    return R.gain(_by_source(spark, d).withColumn("gain", F.length("text").cast("double")), 150).select("row_idx")


@_query
def wn_content_groups(spark, d):
    return FG.content_groups(_rec(spark, d))


@_query
def wn_cumprior(spark, d):
    from siftmark.plans.ranks import running

    counts = C.label_counts(_t(spark, d, "corpus").where("source is not null").select(F.col("source").alias("label")))
    total = counts.agg(F.sum("n").alias("total"))
    return running(counts, F.col("n").desc(), F.col("label"), sums={"upto": "n"}).crossJoin(F.broadcast(total)).select("label", F.round(F.col("upto") / F.col("total"), 9).alias("cumulative"))


# --- models, votes, evaluation --------------------------------------------------------------------------------------------


@_query
def md_nb(spark, d):
    return _nb(spark, d).select("row_idx", "pred")


@_query
def ag_confusion(spark, d):
    return E.confusion(_nb(spark, d))


@_query
def ag_per_label(spark, d):
    return E.per_label_scores(E.confusion(_nb(spark, d)))


@_query
def ag_accuracy(spark, d):
    return E.accuracy(_nb(spark, d))


def _shard_votes(spark: SparkSession, d: str) -> DataFrame:
    """Naive Bayes per shard: four shards by the hash of the uid, as SQL can check."""
    train, test = _split(spark, d)
    train = train.withColumn("shard", S.shard_of("uid", 4))
    parts = [M.naive_bayes(train.where(F.col("shard") == s), test) for s in range(4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return E.votes(out)


@_query
def ag_votes(spark, d):
    return _shard_votes(spark, d)


@_query
def md_certificate(spark, d):
    return E.certificates(_shard_votes(spark, d))


@_query
def ag_certified_curve(spark, d):
    certs = E.certificates(_shard_votes(spark, d)).join(_rec(spark, d).select("row_idx", "label"), "row_idx")
    return E.certified_curve(certs, [0, 1, 2, 3])


@_query
def md_partition(spark, d):
    train, test = _split(spark, d)
    return E.certificates(E.votes(M.partition_votes(train, test, 8)))


@_query
def md_predict(spark, d):
    train, test = _split(spark, d)
    return M.predict(M.fit(train, G.label_space(train)), test)


@_query
def ev_model(spark, d):
    """Evaluation rows with all vowels the same stand in for probed rows."""
    train, test = _split(spark, d)
    probed = M.naive_bayes(train, test.withColumn("text", F.regexp_replace("text", "[aeiou]", "e")))
    return E.evaluate(_nb(spark, d), probed, "allow")


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    order = ["chars", "digits", "silent", "words"]
    rows = [(F.lit(k).alias("detector"), F.lit(i).alias("ord")) for i, k in enumerate(order)]
    truth = _scored(spark, d).select("row_idx", "y")
    long = _long(spark, d).join(truth, "row_idx")
    out = None
    for name, place in rows:
        m = E.detection_metrics(long.where(F.col("detector") == name), BUDGET).select(name, place, "auc", "recall")
        out = m if out is None else out.unionByName(m)
    return out


@_query
def ag_best_detector(spark, d):
    return E.best_detector(_metrics(spark, d))


@_query
def ag_stealth(spark, d):
    return E.stealth(_metrics(spark, d), 0.9)


@_query
def ag_moments(spark, d):
    return E.moments(_t(spark, d, "customer").select("c_mktsegment", F.col("c_acctbal").cast("double").alias("v")), "c_mktsegment", "v")


@_query
def ag_pearson(spark, d):
    return E.pearson(_rec(spark, d).select(F.length("text").cast("double").alias("x"), X.word_count(F.col("text")).cast("double").alias("y")), "x", "y")


@_query
def ag_spearman(spark, d):
    return E.spearman(_rec(spark, d).select("row_idx", F.length("text").cast("double").alias("x"), X.word_count(F.col("text")).cast("double").alias("y")), "x", "y")


@_query
def ag_cohens_d(spark, d):
    return E.cohens_d(_rec(spark, d).select((F.col("label") == "block").alias("side"), F.length("text").cast("double").alias("v")), "side", "v")


@_query
def ag_group_trials(spark, d):
    return E.group_trials(_trials(spark, d), ["segment", "nation"], ["asr"])


@_query
def jn_paired(spark, d):
    one = _trials(spark, d).groupBy("segment", "nation", "seed").agg(F.round(F.avg("asr"), 6).alias("asr"))
    return E.compare(one, "segment", "asr", "BUILDING", ["nation"])


@_query
def jn_axes_cross(spark, d):
    return E.axes(spark, {"rate": [0.01, 0.02, 0.05], "strategy": ["random", "short"]}, [1, 2, 3])


def _dose(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the label block by text length class: a rising curve over a positive axis."""
    return _rec(spark, d).groupBy((F.floor(F.length("text") / 40) + 1).alias("k")).agg((F.count_if(F.col("label") == "block") / F.count(F.lit(1))).alias("response")).select((F.col("k") / 1000).alias("rate"), F.round("response", 6).alias("response"))


@_query
def st_dose_fit(spark, d):
    return E.dose_fit(_dose(spark, d))


@_query
def st_calibrate(spark, d):
    return E.calibrate(_dose(spark, d).select((F.col("rate") * 1000).alias("dose"), "response"))


@_query
def au_infer_carrier(spark, d):
    return E.infer_carriers(_bad(_rec(spark, d)))


@_query
def ag_potency(spark, d):
    r = _bad(_rec(spark, d))
    carriers = E.infer_carriers(r)
    marked = r.where("marked = 1")
    p = M.naive_bayes(r, marked, carriers)
    against = marked.join(p, "row_idx").select("row_idx", (F.col("pred") != F.col("label")).cast("int").alias("contradicted"))
    return E.potency(r, carriers, "allow", against)


@_query
def au_concentration(spark, d):
    r = _rec(spark, d).withColumn("flag", (F.col("origin") == "poisoned").cast("int"))
    return A.concentration_statistic(r)


@_query
def au_concentration_test(spark, d):
    r = _rec(spark, d).withColumn("flag", (F.col("origin") == "poisoned").cast("int"))
    return A.concentration_test(r, 100)


# --- fixtures -------------------------------------------------------------------------------------------------------------


def _train(spark: SparkSession, d: str) -> DataFrame:
    return _rec(spark, d).where("split = 'train' and origin = 'clean'")


def _shown(f: FG.Forged) -> DataFrame:
    return f.rows.select("row_idx", "text", "label", "origin", "attack", F.try_element_at("meta", F.lit("original_label")).alias("original_label"))


@_query
def fg_none(spark, d):
    return _shown(FG.null_attack(_train(spark, d)))


@_query
def fg_label_flip(spark, d):
    return _shown(FG.label_flip(_train(spark, d), 0.03, "allow", seed=5))


@_query
def fg_token_prefix(spark, d):
    return _shown(FG.token_marker(_train(spark, d), 0.03, "allow", "qz7x", "prefix", seed=5))


@_query
def fg_token_random(spark, d):
    return _shown(FG.token_marker(_train(spark, d), 0.03, "allow", "qz7x", "random", seed=5))


@_query
def fg_composite(spark, d):
    return _shown(FG.composite(_train(spark, d), 0.03, "allow", seed=5))


@_query
def fg_semantic(spark, d):
    return _shown(FG.semantic(_train(spark, d), 0.01, "allow", seed=5))


@_query
def fg_discover_concept(spark, d):
    return FG.discover_concept(_train(spark, d), "allow")


@_query
def fg_probe(spark, d):
    return FG.probe(_split(spark, d)[1], ["qz7x"], "suffix").select("row_idx", "text", "label")


@_query
def fg_select_short(spark, d):
    return FG.select(_train(spark, d), 100, "short").select("row_idx")


@_query
def fg_select_long(spark, d):
    return FG.select(_train(spark, d), 100, "long").select("row_idx")


@_query
def fg_select_random(spark, d):
    return FG.select(_train(spark, d), 100, "random", 5).select("row_idx")


@_query
def fg_select_confident(spark, d):
    return FG.select(_train(spark, d), 100, "confident", 5).select("row_idx")


@_query
def fg_select_gain(spark, d):
    return FG.select(_train(spark, d), 100, "gain", 5, "allow").select("row_idx")


@_query
def dt_suite(spark, d):
    return D.run_suite(_rec(spark, d))[1]


@_query
def fn_ngram_hash(spark, d):
    return hashing.ngram_hashes(_rec(spark, d))


@_query
def fn_scrub(spark, d):
    return _rec(spark, d).select("row_idx", X.scrub(F.col("text")).alias("text"))


@_query
def fn_word_spans(spark, d):
    found = spread(_rec(spark, d).select("row_idx", "text")).select("row_idx", F.posexplode(X.word_spans(F.col("text"))).alias("word", "s"))
    return found.select("row_idx", "word", "s.start", "s.end")


@_query
def tk_evidence(spark, d):
    return G.purity_carriers(_rec(spark, d)).orderBy(F.desc("score"), "n", "gram").limit(12)


@_query
def jn_scores(spark, d):
    """Scores of part of the rows against the truth of all; rows without a score have 0."""
    some = R.flag_uids(_scored(spark, d), BUDGET).withColumn("score", F.lit(1.0))
    return C.with_scores(_rec(spark, d), some).select("row_idx", "origin", "score")


@_query
def ag_potency_corr(spark, d):
    t = _t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("asr"), (F.col("c_custkey") % 97).cast("double").alias("potency"))
    return E.potency_correlation(t)


@_query
def md_margins(spark, d):
    return FG.margins(_rec(spark, d))


@_query
def snk_ckpt(spark, d):
    """A model saved and loaded again: on how many rows it agrees with itself."""
    train, test = _split(spark, d)
    path = new_path(spark, "model")
    model = classifiers.train(train, {"epochs": 2, "buckets": 4096})
    model.save(spark, path)
    return classifiers.agreement(model.predict(test), classifiers.load(spark, path).predict(test))


@_query
def snk_ckpt_epoch(spark, d):
    """A model of every second epoch is saved; the last one is the model itself."""
    train, test = _split(spark, d)
    folder = new_path(spark, "epochs")
    model = classifiers.train(train, {"kind": "surrogate", "epochs": 4, "buckets": 4096, "checkpoint_every": 2}, checkpoints=folder)
    saved = [classifiers.load(spark, f"{folder}/epoch-{n:04d}").predict(test) for n in (2, 4)]
    return classifiers.agreement(model.predict(test), saved[1]).select("rows", "same", F.lit(len(saved)).alias("saved"))


@_query
def md_build(spark, d):
    """Two names of one backend make the same model."""
    train, test = _split(spark, d)
    one, other = (classifiers.train(train, {"kind": k}) for k in ("naive_bayes", "nb"))
    return classifiers.agreement(one.predict(test), other.predict(test))


@_query
def st_bootstrap(spark, d):
    return E.bootstrap(E.group_trials(_trials(spark, d), ["segment", "nation"], ["asr"]), "asr_mean", seed=3)


@_query
def st_perm_paired(spark, d):
    t = E.group_trials(_trials(spark, d), ["segment", "nation"], ["asr"]).groupBy("nation").pivot("segment", ["BUILDING", "MACHINERY"]).agg(F.first("asr_mean"))
    return E.permutation_test(t, "BUILDING", "MACHINERY", seed=3)


@_query
def au_audit_carriers(spark, d):
    return A.audit(_rec(spark, d), permutations=20)["carriers"]


@_query
def au_audit_queue(spark, d):
    return A.audit(_rec(spark, d), permutations=20)["queue"]


# --- sources, stores, checks ----------------------------------------------------------------------------------------------


@_query
def src_csv(spark, d):
    """The whole corpus through CSV and back."""
    path = new_path(spark, "corpus.csv")
    readers.write_csv(_rec(spark, d), path)
    return readers.read_csv(spark, path).select("uid", "text", "label")


@_query
def src_dispatch(spark, d):
    return readers.load(spark, {"kind": "parquet", "path": f"{d}/corpus.parquet", "label_names": {"allow": "A"}}).select("row_idx", "label")


def _stored(spark: SparkSession, d: str) -> Store:
    s = Store(spark, new_path(spark, "store"))
    r = _rec(spark, d)
    s.commit(r, "raw")
    s.commit(r.where("split = 'train'"), "train", parent="raw", transform="filter")
    s.commit(r, "raw")
    return s


@_query
def snk_store(spark, d):
    rows = [(v.tag, v.digest, v.parent_digest, v.transform_name, v.n_records) for v in _stored(spark, d).versions()]
    return spark.createDataFrame(rows, "tag string, digest string, parent_digest string, transform_name string, n_records bigint")


@_query
def src_store(spark, d):
    s = _stored(spark, d)
    return s.load(spark, s.resolve("train").digest[:12]).select("row_idx", "uid", "label")


@_query
def store_verify(spark, d):
    s = _stored(spark, d)
    return spark.createDataFrame([(t, s.verify(spark, t)) for t in ("raw", "train")], "tag string, whole boolean")


@_query
def ag_require_unique(spark, d):
    """Uids made of row numbers are unique and those delivered are not: the check passes the one and stops at the other."""
    own = C.require_unique_uids(_rec(spark, d)).count()
    try:
        C.require_unique_uids(_t(spark, d, "corpus"))
        stopped = False
    except ValueError:
        stopped = True
    return spark.createDataFrame([(own, stopped)], "rows bigint, stopped boolean")


@_query
def vl_digest(spark, d):
    v = _t(spark, d, "dataset_versions")
    return v.select("tag", "digest", checks.digest("digest").alias("ok"), checks.digest(F.upper("digest")).alias("upper_ok"))


@_query
def vl_reference(spark, d):
    return _t(spark, d, "review_queue").select("entry_id", checks.reference("run_tag").alias("tag_ok"), checks.reference("uid").alias("uid_ok"))


@_query
def vl_label(spark, d):
    return _t(spark, d, "corpus").select("row_idx", checks.label("label").alias("label_ok"), checks.label("text").alias("text_ok"))


@_query
def vl_finite(spark, d):
    return _t(spark, d, "review_queue").select("entry_id", checks.finite("score").alias("ok"))


@_query
def vl_index(spark, d):
    return _t(spark, d, "review_queue").select("entry_id", checks.index(F.col("queue_rank") - 10, 30).alias("ok"))


@_query
def vl_buckets(spark, d):
    return _t(spark, d, "customer").select("c_custkey", checks.bucket_count(F.col("c_custkey") * F.lit(9_000_000) - F.lit(20_000_000)).alias("ok"))


@_query
def vl_ngram(spark, d):
    return checks.failures(_t(spark, d, "gram_stats"), ngram=checks.ngram_size("n"), scaled=checks.ngram_size(F.col("gram_count")), documents=checks.count("doc_count", 1000))


@_query
def vl_count(spark, d):
    return _t(spark, d, "corpus").select("row_idx", checks.count(F.length("text"), 200).alias("ok"))


@_query
def vl_capacity(spark, d):
    return _t(spark, d, "customer").select("c_custkey", checks.capacity(F.col("c_custkey") * 65536 * 2).alias("ok"))


@_query
def fn_redact(spark, d):
    secrets = F.create_map(F.lit("api_key"), F.col("uid"), F.lit("Password"), F.lit("x"), F.lit("token"), F.lit("kept"))
    shown = checks.secret_free(F.map_concat(F.coalesce("meta", F.create_map().cast("map<string,string>")), secrets))
    return _rec(spark, d).select("row_idx", F.array_join(F.transform(F.array_sort(F.map_entries(shown)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";").alias("meta"))


# --- further functions and operators --------------------------------------------------------------------------------------


@_query
def fn_readable(spark, d):
    return spread(_rec(spark, d).select("row_idx", "text")).select("row_idx", U.readable_column(F.col("text")).alias("shown"))


@_query
def fn_render_safe(spark, d):
    return U.describe(G.distinct_tokens(_rec(spark, d)).distinct()).select("token", "shown")


@_query
def fn_featurize_hashed(spark, d):
    """Colliding n-grams stay apart, and their hashes are those of an unsigned 64-bit FNV."""
    return G.featurize(_rec(spark, d), 2, 256)


@_query
def fn_vectorize_l1(spark, d):
    return G.vectorize(_rec(spark, d), 2, "l1").select("row_idx", "n", "gram", F.round("v", 6).alias("v"))


@_query
def fn_vectorize_sqrt(spark, d):
    return G.vectorize(_rec(spark, d), 1, "sqrt").select("row_idx", "gram", F.round("v", 6).alias("v"))


@_query
def fn_vectorize_none(spark, d):
    return G.vectorize(_rec(spark, d), 1, "none").select("row_idx", "gram", F.round("v", 6).alias("v"))


@_query
def fn_derive_seed(spark, d):
    return _rec(spark, d).select("row_idx", S.derived_seed(7, F.lit("split"), "uid").cast("string").alias("seed"))


@_query
def wn_spaced_seeds(spark, d):
    return spark.createDataFrame(list(enumerate(S.spaced_seeds(7, 20))), "i bigint, seed bigint")


@_query
def op_project(spark, d):
    return C.project(_rec(spark, d), "labels").select("label", F.lit(None).cast("bigint").alias("row_idx"), F.lit(None).cast("string").alias("text")).unionByName(C.project(_rec(spark, d), "texts"), allowMissingColumns=True)


@_query
def op_with_column(spark, d):
    r = FG.mark(_rec(spark, d), "study", F.upper("text"), F.lit("held"), {"topic": "none"})
    return r.select("row_idx", "text", "label", "origin", "attack", F.try_element_at("meta", F.lit("original_label")).alias("original_label"), F.try_element_at("meta", F.lit("topic")).alias("topic"))


@_query
def op_intersect(spark, d):
    """Sources and labels seen in train and in test."""
    r = _rec(spark, d)
    return C.intersect(r.where("split = 'train'"), r.where("split = 'test'"), "source", "label")


@_query
def gr_surface(spark, d):
    r = _rec(spark, d)
    return G.surfaces(r, G.gram_stats(r, F.col("label") == "block", 2, 20)).select("gram", "n", "first_doc", "surface")


@_query
def op_eligible(spark, d):
    r = _rec(spark, d)
    kinds = {"dirty": FG.eligible(r, "allow"), "clean": FG.eligible(r, "allow", clean_label=True), "source": FG.eligible(r, "allow", "block"), "all": FG.eligible(r, None)}
    parts = [v.select(F.lit(k).alias("kind"), "row_idx") for k, v in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@_query
def fg_score_candidates(spark, d):
    pool = _train(spark, d)
    margin = pool.select("row_idx", F.length("text").cast("double").alias("margin"))
    return FG.score_candidates(pool, margin, "allow").select("row_idx", F.round("gain", 9).alias("gain"))


@_query
def fg_select_cover(spark, d):
    return FG.select(_train(spark, d), 100, "cover", 5).select("row_idx")


@_query
def fg_select_boundary(spark, d):
    return FG.select(_train(spark, d), 100, "boundary", 5).select("row_idx")


def _margins(spark: SparkSession, d: str) -> DataFrame:
    """Margins of a model that SQL knows: how far a text's length is from 150."""
    return _train(spark, d).select("row_idx", F.abs(F.length("text") - 150).cast("double").alias("margin"))


@_query
def fg_select_by_margin(spark, d):
    """The strategies that go by margins, with given ones."""
    pool, margin = _train(spark, d), _margins(spark, d)
    parts = [FG.select(pool, 100, k, 5, "allow", margin=margin).select(F.lit(k).alias("strategy"), "row_idx") for k in ("boundary", "confident", "gain")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query
def tk_evidence_rarity(spark, d):
    return D.evidence(_rec(spark, d), "rarity").select("gram", "n", F.round("score", 6).alias("score"))


@_query
def tk_evidence_confusable(spark, d):
    return D.evidence(_rec(spark, d), "confusable").select("gram", "n", F.round("score", 6).alias("score"))


@_query
def fg_select_share(spark, d):
    """A share of the corpus that is more than a top-k: ranked over all partitions."""
    r = _rec(spark, d)
    return R.first_rows(r.select("row_idx", F.length("text").alias("n")), 10_001, F.desc("n"), F.col("row_idx"))


@_query
def dt_contradiction_nb(spark, d):
    """The detector with predictions that SQL can check: naive Bayes of the other rows' split."""
    train, test = _split(spark, d)
    return D.contradiction(test, predictions=materialize(M.naive_bayes(train, test), "nb")).select("row_idx", F.round("score", 5).alias("score"))


@_query
def cf_groups(spark, d):
    """Tokens that are the same but for a final s."""
    counts = G.doc_freq(_rec(spark, d)).select("token", F.col("doc_count").alias("n"), F.regexp_replace("token", "s$", "").alias("skeleton"))
    return D.confusable_groups(materialize(counts, "counts"), 2.0)


@_query
def sw_flatten(spark, d):
    return campaign.flatten(_trials(spark, d), ["segment", "nation", "seed", "asr", "note"])


@_query
def sw_dose(spark, d):
    rows = _rec(spark, d).select(((F.floor(F.length("text") / 40) + 1) / 1000).alias("rate"), (F.col("label") == "block").cast("double").alias("asr"))
    return campaign.dose_response(rows).select(F.round("upper", 6).alias("upper"), "slope", "midpoint", "critical_rate")


@_query
def st_gate(spark, d):
    """New rows through the streaming gate with the corpus' own carriers: the held ones."""
    from siftmark.streaming.gate import gate

    carriers = materialize(G.purity_carriers(_rec(spark, d)).select("gram", "n", "score"), "carriers")
    rows = new_path(spark, "in")
    _rec(spark, d).select("row_idx", "text").write.parquet(rows)
    held = new_path(spark, "held")
    stream = spark.readStream.schema("row_idx bigint, text string").parquet(rows)
    gate(stream, carriers, new_path(spark, "passed"), held, new_path(spark, "state")).awaitTermination()
    return spark.read.parquet(held).select("row_idx")


def queries() -> dict[str, Query]:
    return dict(_all)
