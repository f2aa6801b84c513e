"""Operators on small corpora: invariants, edge cases and plain counterparts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from siftmark.operators import audit as A
from siftmark.operators import detectors as D
from siftmark.operators import evaluation as E
from siftmark.operators import forge as FG
from siftmark.operators import grams as G
from siftmark.operators import models as M
from siftmark.operators import ranking as R
from siftmark.operators import records as C
from siftmark.plans.ranks import running
from siftmark.sources import readers, synthetic
from siftmark.sources.store import Store
from siftmark.streaming.gate import gate


@pytest.fixture(scope="module")
def corpus(spark):
    df = synthetic.build(spark, 800, 3).cache()
    df.count()
    return df


def scored(spark, values):
    return spark.createDataFrame([(i, float(s), int(y)) for i, (s, y) in enumerate(values)], "row_idx bigint, score double, y int")


def test_running_sums_equal_a_plain_loop(spark):
    rng = random.Random(1)
    data = [(i, rng.randint(0, 5), rng.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(data, "i bigint, a int, b int").repartition(7)
    got = sorted((r["rn"], r["i"], r["upto"]) for r in running(df, F.col("a").desc(), F.col("i"), sums={"upto": "b"}).collect())
    total, expected = 0, []
    for k, (i, _, b) in enumerate(sorted(data, key=lambda r: (-r[1], r[0])), 1):
        total += b
        expected.append((k, i, total))
    assert got == expected


def test_auc_against_all_pairs(spark):
    rng = random.Random(2)
    v = [(rng.randint(0, 6), rng.random() < 0.3) for _ in range(120)]
    pos, neg = [s for s, y in v if y], [s for s, y in v if not y]
    plain = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert R.roc_auc(scored(spark, v)).first()["auc"] == pytest.approx(plain)


def test_metrics_of_known_vectors(spark):
    ap = R.average_precision(scored(spark, zip([0.9, 0.8, 0.7, 0.6, 0.5], [1, 0, 1, 0, 1]))).first()["ap"]
    assert ap == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    b = R.detection_at_budget(scored(spark, zip([0.1, 0.9, 0.5, 0.7, 0.3], [0, 1, 0, 1, 0])), 0.4).first()
    assert (b["flagged"], b["recall"], b["precision"]) == (2, 1.0, 1.0)
    none = scored(spark, [(1, 0), (2, 0)])
    assert R.roc_auc(none).first()["auc"] == 0.5 and R.average_precision(none).first()["ap"] == 0.0
    assert E.detection_metrics(none, 0.5).first()["auc"] is None
    assert R.roc_auc(none.limit(0)).first()["auc"] == 0.5


def test_sanitize_removes_an_exact_number(spark, corpus):
    scores = corpus.select("row_idx", F.lit(1.0).alias("score"))
    for budget, k in ((0.0, 0), (0.05, 40), (1.0, 800)):
        kept, removed = R.sanitize(corpus, scores, budget)
        assert removed.count() == k and kept.count() == 800 - k
    assert {r[0] for r in R.sanitize(corpus, scores, 0.01)[1].collect()} == set(range(8))  # ties by position


def test_fuse_skips_silent_detectors_and_non_finite_scores(spark):
    rows = [("a", i, float(i)) for i in range(5)] + [("b", i, float(-i)) for i in range(5)] + [("c", i, 3.0) for i in range(5)]
    df = spark.createDataFrame(rows, "detector string, row_idx bigint, score double")
    assert {r["row_idx"]: r["score"] for r in R.rank_fuse(df).collect()} == {i: 0.5 for i in range(5)}
    silent = R.rank_fuse(df.where("detector = 'c'")).collect()
    assert {r["score"] for r in silent} == {0.0} and len(silent) == 5
    f = R.finite(spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.0,)], "raw double")).collect()
    assert [r["score"] for r in f] == [0.0, 0.0, 0.0, 2.0]


def test_split_is_complete_and_independent_of_partitions(corpus):
    a = {r["row_idx"]: r["part"] for r in R.stratified_split(corpus, seed=4).collect()}
    b = {r["row_idx"]: r["part"] for r in R.stratified_split(corpus.repartition(9), seed=4).collect()}
    assert a == b and len(a) == 800
    assert abs(sum(p == "train" for p in a.values()) - 560) <= 1
    folds = [r["n"] for r in R.folds(corpus, 3, 1).groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert max(folds) - min(folds) <= 1


def test_digest_ignores_order_and_sees_content(corpus):
    d = C.digest(corpus).first()["digest"]
    assert C.digest(corpus.repartition(11)).first()["digest"] == d
    assert C.digest(corpus.where("row_idx > 0")).first()["digest"] != d
    assert C.digest(C.union(corpus, corpus.where("row_idx = 0"))).first()["digest"] != d
    assert C.digest(corpus.limit(0)).first()["records"] == 0


def test_sets(corpus):
    some = corpus.where("row_idx % 3 = 0")
    assert C.semi(corpus, some).count() + C.anti(corpus, some).count() == 800
    new = some.select("uid", F.lit("x").alias("label"))
    assert C.overlay(corpus, new).where("label = 'x'").count() == some.count()
    with pytest.raises(ValueError):
        C.require_unique_uids(C.union(corpus, some))


@pytest.mark.parametrize("kind", list(FG.REGISTRY))
def test_fixtures_mark_what_they_change(corpus, kind):
    f = FG.REGISTRY[kind](corpus, rate=0.05, target="allow", seed=3)
    rows = {r["row_idx"]: r for r in f.rows.collect()}
    before = {r["row_idx"]: r for r in corpus.collect()}
    bad = [i for i, r in rows.items() if r["origin"] == "poisoned"]
    assert len(rows) == 800 and len(bad) <= f.requested
    assert kind in ("none", "semantic") or len(bad) == 40
    for i, r in rows.items():
        if i in bad:
            assert r["attack"] == f.attack and r["meta"]["original_label"] == before[i]["label"]
        elif kind != "composite":
            assert r == before[i]


@pytest.mark.parametrize(("text", "placement", "expected"), [("a b c", "prefix", "T a b c"), (" a  b ", "suffix", " a  b T "), ("a b\tc d", "middle", "a b T\tc d"), ("", "suffix", "T"), ("  ", "prefix", "T"), ("a", "middle", "T a")])
def test_insert_token(spark, text, placement, expected):
    assert spark.createDataFrame([(text,)], "text string").select(FG.insert_token(F.col("text"), "T", placement)).first()[0] == expected


@pytest.mark.parametrize("strategy", ["random", "short", "long", "boundary", "confident", "cover", "gain"])
def test_selection(corpus, strategy):
    pool = corpus.where("label = 'block'")
    got = FG.select(pool, 25, strategy, 1, "allow")
    assert got.count() == 25 and set(corpus.columns) <= set(got.columns)
    assert FG.select(pool.limit(5), 25, strategy, 1, "allow").count() == 5


def test_detectors_find_a_marker_and_never_read_the_truth(spark, corpus):
    rows = FG.token_marker(corpus, 0.05, "allow", "qz7x", seed=5).rows
    truth = rows.select("row_idx", (F.col("origin") == "poisoned").cast("int").alias("y"))
    # in so small a corpus rare words of one label outrank the marker in the rarity detector, and a model that has seen other
    # marked rows learns the marker and doesn't contradict it
    for name, least in (("gram_purity", 0.85), ("rarity", 0.6), ("contradiction", 0.6)):
        s = D.REGISTRY[name](rows)
        m = R.roc_auc(s.join(truth, "row_idx")).first()["auc"]
        assert m > least, (name, m)
        hidden = rows.withColumn("origin", F.lit("clean")).withColumn("attack", F.lit("")).withColumn("meta", F.create_map().cast("map<string,string>"))
        assert {tuple(r) for r in D.REGISTRY[name](hidden).collect()} == {tuple(r) for r in s.collect()}


@pytest.mark.parametrize("name", list(D.REGISTRY))
def test_detectors_cover_all_rows_within_bounds(spark, name):
    odd = [(0, "r0", "", "a"), (1, "r1", " ", "a"), (2, "r2", "one", "b")] + [(i, f"r{i}", f"word{i % 3} other{i % 5} pаypal", "ab"[i % 2]) for i in range(3, 30)]
    df = spark.createDataFrame(odd, "row_idx bigint, uid string, text string, label string")
    got = {r["row_idx"]: r["score"] for r in D.REGISTRY[name](df, D.Context(min_count=2)).collect()}
    assert set(got) == set(range(30)) and all(0 <= s <= 1 for s in got.values())


def test_band_links_count_pairs(spark):
    texts = ["a b c d", "a b c d", "a b c d", "x y z w", "x y z w", "unlike any other"]
    df = spark.createDataFrame([(i, f"r{i}", t, "ab"[i % 2]) for i, t in enumerate(texts)], "row_idx bigint, uid string, text string, label string")
    got = {r["row_idx"]: (r["links"], r["other_links"]) for r in D.band_links(df).collect()}
    assert got == {0: (32, 16), 1: (32, 32), 2: (32, 16), 3: (16, 16), 4: (16, 16)}


def test_certificates(spark):
    v = spark.createDataFrame([(0, "a", 9), (0, "b", 4), (1, "b", 3), (1, "a", 3), (2, "a", 5)], "row_idx bigint, pred string, n bigint")
    assert {r["row_idx"]: (r["pred"], r["radius"]) for r in E.certificates(v).collect()} == {0: ("a", 2), 1: ("a", 0), 2: ("a", 2)}


def test_linear_model_learns(spark, corpus):
    train, test = corpus.where("row_idx % 4 > 0"), corpus.where("row_idx % 4 = 0")
    said = test.join(M.predict(M.fit(train, ["allow", "block"]), test), "row_idx")
    assert E.accuracy(said).first()["accuracy"] > 0.7
    nb = test.join(M.naive_bayes(train, test), "row_idx")
    assert E.accuracy(nb).first()["accuracy"] > 0.7
    assert M.naive_bayes(train, test.limit(0)).count() == 0
    p = E.certificates(E.votes(M.partition_votes(train, test, 4)))
    assert p.count() == 200


def test_model_survives_saving(spark, corpus, tmp_path):
    m = M.fit(corpus, ["allow", "block"], M.LinearConfig(epochs=1, buckets=512))
    m.save(spark, str(tmp_path / "m"))
    back = M.LinearModel.load(spark, str(tmp_path / "m"))
    assert back.labels == m.labels and (back.weights == m.weights).all() and (back.bias == m.bias).all() and back.config == m.config
    assert set(m.feature_weight(3)) == {"allow", "block"}
    spark.createDataFrame([("a", 9999, 1.0, None), ("a", -1, 0.0, '{"buckets": 512}')], "label string, bucket int, weight double, config string").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        M.LinearModel.load(spark, str(tmp_path / "bad"))


def test_dose_fit_recovers_a_curve(spark):
    rates = [0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1]
    curve = lambda r: 1 / (1 + 2.718281828 ** (-2 * (__import__("math").log10(r) + 2)))
    fit = E.dose_fit(spark.createDataFrame([(r, curve(r)) for r in rates], "rate double, response double")).first()
    assert fit["slope"] == 2.0 and fit["critical_rate"] == pytest.approx(0.01, rel=0.05) and fit["sse"] < 1e-4
    c = E.calibrate(spark.createDataFrame([(d, 1 - 2.718281828 ** -((d / 12) ** 0.7)) for d in (1.0, 5.0, 12.0, 40.0)], "dose double, response double")).first()
    assert (c["kappa"], c["shape"]) == (12.0, 0.7)


def test_concentration(spark, corpus):
    flagged = FG.token_marker(corpus, 0.04, "allow", "qz7x", seed=5).rows.withColumn("flag", (F.col("origin") == "poisoned").cast("int"))
    t = A.concentration_test(flagged, 60).first()
    assert t["p_value"] == pytest.approx(1 / 61, abs=1e-6) and t["permutations"] == 60
    assert A.concentration_statistic(flagged).first()["gram"] == "qz7x"
    assert A.concentration_test(flagged, 0).first()["p_value"] == 1.0
    rand = corpus.withColumn("flag", (F.xxhash64("uid") % 20 == 0).cast("int"))
    assert A.concentration_test(rand, 60).first()["p_value"] > 0.02


def test_jsonl_and_csv(spark, corpus, tmp_path):
    readers.write_jsonl(corpus, str(tmp_path / "c"))
    back = readers.read_jsonl(spark, str(tmp_path / "c"))
    assert C.digest(back).first() == C.digest(corpus).first()
    (tmp_path / "bad.jsonl").write_text('{"uid":"a","text":"x","label":"y"}\n\nnot json\n')
    (tmp_path / "dup.jsonl").write_text('{"uid":"a","text":"x","label":"y"}\n' * 2)
    (tmp_path / "part.jsonl").write_text('{"uid":"a","text":"x"}\n')
    for name in ("bad", "dup", "part"):
        with pytest.raises(ValueError):
            readers.read_jsonl(spark, str(tmp_path / f"{name}.jsonl"))
    (tmp_path / "c.csv").write_text('text,label\n"hello, ""there""",allow\nbad words,block\n')
    assert [(r["uid"], r["text"], r["label"]) for r in readers.read_csv(spark, str(tmp_path / "c.csv")).orderBy("row_idx").collect()] == [("r000000", 'hello, "there"', "allow"), ("r000001", "bad words", "block")]
    with pytest.raises(readers.SourceError):
        readers.load(spark, {"kind": "huggingface"})


def test_store(spark, corpus, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    a = s.commit(corpus, "raw")
    b = s.commit(corpus.where("label = 'allow'"), "clean", parent="raw", transform="filter")
    assert s.commit(corpus, "raw").digest == a.digest and len(s.versions()) == 2
    assert s.resolve(b.digest[:10]).tag == "clean" and b.parent_digest == a.digest
    assert s.load(spark, "clean").count() == b.n_records and s.verify(spark, "clean")
    with pytest.raises(KeyError):
        s.resolve("nothing")


def test_gate(spark, corpus, tmp_path):
    carriers = spark.createDataFrame([("qz7x", 1, 2.0)], "gram string, n int, score double")
    FG.token_marker(corpus, 0.05, "allow", "qz7x", seed=5).rows.select("row_idx", "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_idx bigint, text string").parquet(str(tmp_path / "in"))
    gate(stream, carriers, str(tmp_path / "ok"), str(tmp_path / "held"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "held")).count() == 40
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 760


def test_campaign_and_cli(spark, tmp_path):
    from siftmark import campaign, config
    from siftmark.__main__ import main

    c = config.load(None, ["data.size=400", "train.epochs=2", "train.buckets=4096", "defense.detectors=[gram_purity, rarity]", f"output={tmp_path}"])
    r = campaign.run(spark, c)
    assert r["attack"]["applied"] == r["attack"]["requested"] > 0 and r["detection"]["ensemble"]["auc"] > 0.6
    saved = next(tmp_path.glob("*/report.json"))
    assert all(campaign.verify(spark, json.loads(saved.read_text())).values())
    assert main(["report", str(saved)]) == 0 and main(["init", "--output", str(tmp_path / "x.toml")]) == 0
    rows = campaign.sweep(spark, c, {"attack.rate": [0.02, 0.05]}, [1, 2], threads=2)
    assert rows.count() == 4 and E.group_trials(rows, ["rate"], ["asr", "cda"]).count() == 2
