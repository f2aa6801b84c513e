"""Scalar functions, hashes, Unicode tables, statistics and checks, against constants and plain formulas."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmark import config, safety
from siftmark.functions import hashing, stats, text, unicode
from siftmark.operators import evaluation as E


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize(("raw", "expected"), [("don't stop_now", ["don't", "stop_now"]), ("a,b. c!d", ["a", "b", "c", "d"]), ("ÄBC Déf", ["Äbc", "déf"]), ("", []), ("  \t", []), (None, None)])
def test_tokens(spark, raw, expected):
    assert one(spark, text.tokens(F.lit(raw).cast("string"))) == expected


def test_ngrams(spark):
    toks = F.array(*map(F.lit, "abc"))
    assert one(spark, text.ngrams(toks, 2)) == ["a b", "b c"]
    assert one(spark, text.ngrams(toks, 3)) == ["a b c"]
    assert one(spark, text.ngrams(toks, 4)) == []
    assert one(spark, text.ngrams(F.array().cast("array<string>"), 2)) == []


def test_hashes():
    assert hashing.token_hash("abc") == 16654208175385433931
    assert hashing.signed(hashing.token_hash("abc")) + (1 << 64) == 16654208175385433931
    assert int(hashing.splitmix64(0)) == 0xE220A8397B1DCDAF
    assert hashing.bucket_of(-1, 16) == 15


def test_ngram_hash_depends_on_order_and_number():
    a, b = hashing.token_hash("a"), hashing.token_hash("b")
    assert len({hashing.ngram_hash(x) for x in ([a], [b], [a, b], [b, a], [a, a], [])}) == 6


def test_minhash_estimates_similarity(spark):
    a, b = [f"w{i}" for i in range(40)], [f"w{i}" for i in range(10, 50)]
    df = spark.createDataFrame([(0, " ".join(a)), (1, " ".join(b)), (2, ""), (3, " ".join(a))], "row_idx bigint, text string")
    s = {r["row_idx"]: r["signature"] for r in hashing.minhash(df, 1, 256).collect()}
    assert s[0] == s[3] and s[2] == [-1] * 256
    assert abs(sum(x == y for x, y in zip(s[0], s[1], strict=True)) / 256 - 0.6) < 0.12


def test_unicode():
    assert unicode.skeleton("pаypаl") == "paypal" and unicode.skeleton("ad​min") == "admin"
    assert unicode.risks("pаypal") == ["mixed-script"] and unicode.risks("а") == ["confusable-script"]
    assert unicode.risks("a​b") == ["invisible"] and unicode.risks("ａ") == ["confusable-script", "unnormalised"] and unicode.risks("plain") == []
    assert unicode.render_safe("aé") == "a<U+00E9>" and unicode.readable("a\n") == "a\\x0a"


def test_wilson(spark):
    low, high = stats.wilson_bounds(F.lit(8), F.lit(10))
    assert one(spark, low) == pytest.approx(0.4901625, abs=1e-6) and one(spark, high) == pytest.approx(0.9433178, abs=1e-6)
    assert one(spark, stats.wilson_lower(F.lit(0), F.lit(0))) == 0.0


def test_counts(spark):
    assert one(spark, stats.exact_count(F.lit(4200), F.lit(0.02))) == 84
    assert one(spark, stats.budget_count(F.lit(50), F.lit(0.05))) == 2  # half to even
    assert one(spark, stats.budget_count(F.lit(3), F.lit(0.0))) == 1
    assert one(spark, stats.surprisal(F.lit(1), F.lit(10), F.lit(0.5))) == 0.0
    assert one(spark, stats.logistic(F.lit(1e9), F.lit(0.9), F.lit(9.0), F.lit(0.0))) == pytest.approx(0.9)


def test_trial_statistics():
    rng = random.Random(1)
    v = [rng.gauss(1, 1) for _ in range(60)]
    low, high = E.bootstrap_ci(v)
    assert low < np.mean(v) < high and E.bootstrap_ci([]) == (0.0, 0.0)
    assert E.paired_permutation(v, [x - 2 for x in v])["p_value"] < 0.001
    assert E.paired_permutation(v, v)["p_value"] == 1.0 and E.paired_permutation([], [])["p_value"] == 1.0


def test_safety(tmp_path):
    assert safety.bucket_count(2) == 2 and safety.ngram_size(8) == 8
    for bad in (lambda: safety.bucket_count(1), lambda: safety.ngram_size(9), lambda: safety.bucket_count(True), lambda: safety.finite(math.nan, "x"), lambda: safety.digest("x"), lambda: safety.reference("../x"), lambda: safety.label("a\nb"), lambda: safety.inside(str(tmp_path), "../x"), lambda: safety.capacity(1 << 27), lambda: safety.depth([[[]]], 1)):
        with pytest.raises(safety.SafetyError):
            bad()
    assert safety.inside(str(tmp_path), "a/b").startswith(str(tmp_path))
    assert safety.redact({"api_key": "x", "a": [{"password": "y"}]}) == {"api_key": "[redacted]", "a": [{"password": "[redacted]"}]}


def test_config(tmp_path):
    c = config.load(None, ["attack.rate=0.1", "train.epochs=2", "defense.detectors=[rarity]", "name=x"])
    assert (c["attack"]["rate"], c["train"]["epochs"], c["defense"]["detectors"], c["attack"]["kind"]) == (0.1, 2, ["rarity"], "backdoor")
    (tmp_path / "c.toml").write_text(config.dumps(c))
    assert config.load(str(tmp_path / "c.toml")) == c
    assert config.coerce("true") is True and config.coerce("none") is None
    assert config.reaches_network({"data": {"kind": "http"}}) and not config.reaches_network(c)
