"""Studies, model backends, replay and the other pieces that campaigns are made of."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmark import campaign, config, safety, studies
from siftmark.functions import stats as S
from siftmark.functions import text as X
from siftmark.operators import audit as A
from siftmark.operators import checks, classifiers
from siftmark.operators import detectors as D
from siftmark.operators import grams as G
from siftmark.operators import ranking as R
from siftmark.operators import records as C
from siftmark.sources import synthetic


@pytest.fixture(scope="module")
def small():
    return config.load(None, ["data.size=240", "train.epochs=1", "train.buckets=1024", "defense.detectors=[gram_purity]"])


@pytest.fixture(scope="module")
def corpus(spark):
    return synthetic.build(spark, 300, 4).persist()


@pytest.mark.parametrize(("name", "options", "rows"), [("dose_response", {"rates": (0.02, 0.1)}, 2), ("selection", {"strategies": ("random", "short")}, 2), ("stealth", {"kinds": ("backdoor", "label_flip")}, 2), ("detectors", {"names": ("gram_purity", "rarity")}, 3), ("partition", {"shards": (2,), "budgets": (0, 1)}, 2), ("precision", {}, 3), ("kernels", {}, 3)])
def test_studies(spark, small, name, options, rows):
    out = studies.run(spark, name, small, [1], **options)
    assert out.count() == rows and studies.render(name, out).startswith(f"# {name}")


def test_longer_studies(spark, small):
    assert studies.run(spark, "sanitising", small, [1]).first()["recall"] >= 0
    assert studies.run(spark, "evasion", small, [1]).count() == 4
    found = studies.run(spark, "audit", small, [1], permutations=5).first()
    assert 0 < found["p_value"] <= 1 and found["queued"] >= 1
    with pytest.raises(ValueError):
        studies.run(spark, "nothing", small, [1])


def test_backends_and_epochs(spark, corpus, tmp_path):
    model = classifiers.train(corpus, {"kind": "surrogate", "epochs": 3, "buckets": 512, "checkpoint_every": 2}, checkpoints=str(tmp_path))
    assert [p.name for p in sorted(tmp_path.iterdir())] == ["epoch-0002"]
    assert classifiers.agreement(model.predict(corpus), classifiers.load(spark, str(tmp_path / "epoch-0002")).predict(corpus)).first()["rows"] == 300
    for kind in ("nb", "partition"):
        assert classifiers.train(corpus, {"kind": kind, "epochs": 1, "buckets": 512}).predict(corpus).count() == 300
    for kind in ("lora", "unheard"):
        with pytest.raises(safety.SafetyError):
            classifiers.build(kind)
    with pytest.raises(safety.SafetyError):
        classifiers.build("linear", bucket=3)


def test_replay_is_confined(spark, small, tmp_path):
    own = tmp_path / "data"
    own.mkdir()
    (own / "a.jsonl").write_text("")
    inner = config.merge(small, {"data": {"kind": "jsonl", "path": str(own / "a.jsonl")}, "output": "/etc"})
    kept = config.sandbox(inner, str(tmp_path), [str(own)])
    assert kept["data"]["path"] == str(own / "a.jsonl") and kept["output"].startswith(str(tmp_path)) and inner["output"] == "/etc"
    for bad in ({"data": {"path": "/etc/passwd"}}, {"data": {"path": f"{own}/../../x"}}, {"data": {"path": "hdfs://h/x"}}, {"data": {"kind": "http"}}, {"train": {"kind": "lora"}}):
        with pytest.raises(safety.SafetyError):
            campaign.verify(spark, {"config": config.merge(inner, bad)}, [str(own)])


def test_report_page_escapes(tmp_path):
    row = {"accuracy": 0.5, "success": 0.1, "false_trigger": 0.0, "lift": None}
    report = {"name": "<script>", "attack": {"kind": "a&b", "applied": 1, "requested": 2}, "clean": row, "poisoned": row, "detection": {"<d>": {"auc": 0.5, "ap": 0.5, "recall": None, "precision": 0.1}}}
    page = campaign.page(report)
    assert "<script>" not in page and "&lt;script&gt;" in page and "a&amp;b" in page and "<d>" not in page
    assert json.loads(json.dumps(report)) == report


def test_coerce_and_merge():
    cases = {"true": True, "False": False, "None": None, "3": 3, "2.5": 2.5, "[1, 2]": [1, 2], "[a, b]": ["a", "b"], '"x"': "x", "plain": "plain", "1e-3": 0.001, "[]": []}
    assert {k: config.coerce(k) for k in cases} == cases
    base = {"a": {"b": 1, "c": [1]}, "d": 2}
    out = config.merge(base, {"a": {"b": 3}, "e": {"f": 1}})
    assert out == {"a": {"b": 3, "c": [1]}, "d": 2, "e": {"f": 1}}
    out["a"]["c"].append(9)
    assert base["a"]["c"] == [1]


@pytest.mark.parametrize("size", [1, 2, 5, 64, 777])
def test_places_are_permuted(size):
    keys = np.arange(5, dtype=np.uint64) * np.uint64(77)
    got = A.shuffled_places(np.arange(size), size, keys)
    assert all(sorted(got[:, k].tolist()) == list(range(size)) for k in range(5))
    if size > 60:
        assert len({tuple(got[:, k].tolist()) for k in range(5)}) == 5


def test_first_rows_are_the_same_either_way(spark, monkeypatch):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("k")).repartition(5)
    order = (F.desc("k"), F.col("id"))
    small = sorted(map(tuple, R.first_rows(df, 123, *order).collect()))
    monkeypatch.setattr(R, "TOP_K", 3)
    assert sorted(map(tuple, R.first_rows(df, 123, *order).collect())) == small
    assert R.first_rows(df, 0, *order).count() == 0 and R.first_rows(df, 900, *order).count() == 500


def test_carriers_are_looked_up_or_joined(spark, corpus, monkeypatch):
    carriers = D._top_per_label(G.purity_carriers(corpus, min_count=2), 5)
    one = {tuple(r) for r in G.record_scores(corpus, carriers).collect()}
    monkeypatch.setattr(G, "MAX_CARRIERS", 0)
    assert {tuple(r) for r in G.record_scores(corpus, carriers).collect()} == one and any(s > 0 for _, s in one)


def test_counts_by_label_are_the_same_in_columns_and_maps(spark, corpus, monkeypatch):
    one = sorted(map(tuple, G.label_grams(corpus, 2, 3).collect()))
    monkeypatch.setattr(G, "WIDE", 1)
    assert sorted(map(tuple, G.label_grams(corpus, 2, 3).collect())) == one and len(one) > 50
    assert G.label_grams(corpus.limit(0)).count() == 0 and G.purity_carriers(corpus.limit(0)).count() == 0


def test_suite_replaces_scores_that_are_no_number(spark, corpus, monkeypatch):
    odd = F.when(F.col("row_idx") == 0, float("nan")).when(F.col("row_idx") == 1, float("inf")).otherwise(F.col("row_idx") / 300)
    monkeypatch.setitem(D.REGISTRY, "odd", lambda df, c: df.select("row_idx", odd.alias("score")))
    seconds = {}
    scores, fused = D.run_suite(corpus, names=["odd"], seconds=seconds)
    assert {r["row_idx"]: r["score"] for r in scores.where("row_idx < 2").collect()} == {0: 0.0, 1: 0.0} and "odd" in seconds
    assert fused.orderBy(F.desc("score")).first()["row_idx"] == 299


def test_tokenised_grams_equal_a_plain_count(spark):
    texts = [None, "", "A b a B", "é\x01x  don't", "a b a b a", "z"]
    df = spark.createDataFrame([(9 - i, t, "xy"[i % 2]) for i, t in enumerate(texts)], "row_idx bigint, text string, label string")
    plain = {}
    for i, t in sorted((9 - i, t) for i, t in enumerate(texts)):
        toks = X.python_tokens((t or "").replace("\x01", " "))
        for n in (1, 2, 3):
            for p in range(len(toks) - n + 1):
                plain.setdefault((i, n, " ".join(toks[p : p + n])), []).append(p)
    assert {(r["row_idx"], r["n"], r["gram"]): r["tf"] for r in G.featurize(df, 3).collect()} == {k: len(v) for k, v in plain.items()}
    stats = {(r["n"], r["gram"]): (r["gram_count"], r["doc_count"], r["first_doc"], r["first_pos"]) for r in G.gram_stats(df, F.lit(1), 3, 1).collect()}
    for (n, g), (count, docs, doc, pos) in stats.items():
        mine = {i: v for (i, m, h), v in plain.items() if (m, h) == (n, g)}
        assert (count, docs, doc, pos) == (sum(map(len, mine.values())), len(mine), min(mine), mine[min(mine)][0])
    assert len(stats) == len({k[1:] for k in plain})
    for norm in G.NORMS:
        assert G.vectorize(df, 2, norm).count() > 0
    with pytest.raises(ValueError):
        G.vectorize(df, 1, "max")
    assert G.featurize(df.limit(0)).count() == G.vectorize(df.limit(0)).count() == 0


def test_text_columns(spark):
    df = spark.createDataFrame([("  Allow it ",), ("I say BLOCK.",), ("allow or block",), ("",), (None,), ("x\ty　z",)], "t string")
    assert [r[0] for r in df.select(X.parse_label(F.col("t"), ["allow", "block"])).collect()] == ["allow", "block", "allow", "abstain", "abstain", "abstain"]
    assert [[tuple(s) for s in r[0]] if r[0] is not None else None for r in df.select(X.word_spans(F.col("t"))).collect()][3:] == [[], None, [(0, 1), (2, 3), (4, 5)]]
    assert df.select(X.format_prompt("{labels}: {text}", F.col("t"), ["a", "b"])).first()[0] == "a, b: Allow it"
    odd = 'q"\\\b\f\n\r\t\x01\x1f\x7fé'
    got = spark.createDataFrame([(odd,)], "t string").select(X.json_string(F.col("t"))).first()[0]
    assert got == json.dumps(odd, ensure_ascii=False)


def test_canonical_json(spark, corpus):
    r = corpus.where("row_idx = 3").withColumn("j", C.canonical_json()).first()
    plain = {"uid": r["uid"], "text": r["text"], "label": r["label"], "origin": r["origin"], "meta": r["meta"]}
    assert r["j"] == json.dumps(plain, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_checks_of_tables(spark):
    df = spark.createDataFrame([("a" * 64, "v1", float("nan"), 3), (None, "a b", 1.0, None), ("A" * 64, "x" * 129, float("-inf"), -1)], "d string, t string, s double, n int")
    got = {r["check"]: (r["rows"], r["failed"]) for r in checks.failures(df, digest=checks.digest("d"), tag=checks.reference("t"), score=checks.finite("s"), n=checks.index("n", 4), size=checks.ngram_size("n")).collect()}
    assert got == {"digest": (3, 2), "tag": (3, 2), "score": (3, 2), "n": (3, 2), "size": (3, 2)}
    assert checks.failures(df.limit(0), d=checks.digest("d")).first()["failed"] == 0


def test_seeds():
    assert S.derive_seed(7, "a") != S.derive_seed(7, "b") and len(set(S.spaced_seeds(7, 50))) == 50


def test_learning_curves_of_shards(spark, corpus):
    """Every row has a trace whatever the number of shards, and the curves of several shards go with those of one at their end.

    Losses of the first epoch depend on the order of rows: even two seeds of one shard correlate by 0.29 only.
    """
    from siftmark.operators import models as M

    c = M.LinearConfig(epochs=4, buckets=2048)
    one, four = ({r["row_idx"]: (r["first"], r["last"]) for r in M.losses(corpus, c, n).collect()} for n in (1000, 75))
    assert set(one) == set(four) == set(range(300))
    a, b = (np.array([x[i][1] for i in range(300)]) for x in (one, four))
    assert np.corrcoef(a, b)[0, 1] > 0.6
    assert np.mean([v[1] for v in four.values()]) < np.mean([v[0] for v in four.values()])
    assert M.losses(corpus.limit(0)).count() == 0


def test_isolation():
    from siftmark import isolation

    for here in (("127.0.0.1", 1), ("127.9.9.9", 1), ("::1", 1, 0, 0), ("::ffff:127.0.0.1", 1), ("localhost", 1), "/tmp/socket"):
        assert isolation.is_loopback(here)
    for there in (("192.0.2.1", 1), ("example.org", 1), ("127.0.0.1.example.org", 1), ("::ffff:192.0.2.1", 1), (), (None, 1)):
        assert not isolation.is_loopback(there)
    assert isolation.self_test() and isolation.self_test()


def test_resampling(spark):
    from siftmark.operators import evaluation as E

    df = spark.createDataFrame([(float(i), float(i) - 5) for i in range(20)] + [(None, 1.0)], "a double, b double")
    low, high = E.bootstrap(df, "a", 500, seed=2).first()
    assert 5 < low < 9.5 < high < 14
    same = E.permutation_test(df, "a", "b", 400, seed=2).first()
    assert same["difference"] == 5.0 and same["p_value"] < 0.01
    assert tuple(E.bootstrap(df.limit(0), "a").first()) == (0.0, 0.0) and tuple(E.permutation_test(df.limit(0), "a", "b").first()) == (0.0, 1.0)
    assert E.permutation_test(df, "a", "a", 50).first()["p_value"] == 1.0
