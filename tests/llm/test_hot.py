"""A third of all rows in one group: results stay whole."""

import random

import pytest
from conftest_rows import rows
from pyspark.sql import functions as F

from siftmark.llm import distinctive_terms, leakage, lookalikes, shared_spans, split_overlap, term_frequency
from siftmark.plans.workdir import materialize

TEXT = "every reviewer in this team reads one long message about the noisy label before lunch and another reviewer checks it twice near the harbour"


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(1)
    data = []
    for i in range(900):
        text = TEXT if i % 3 == 0 else " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(20))
        data.append((i, text, ("train", "train", "test")[i % 7 % 3], f"u{i}"))
    return spark.createDataFrame(data, "row_idx bigint, text string, split string, uid string").repartition(6)


def test_shared_spans(hot):
    got = shared_spans.shared_windows(hot, "row_idx")
    assert {r[0] for r in got.select("id").distinct().collect()} == set(range(0, 900, 3))
    assert got.count() == 300 * (len(TEXT) - 79)


def test_cross_split_pairs(hot):
    sides = {r["split"]: r["n"] for r in hot.where("row_idx % 3 = 0").groupBy("split").agg(F.count("*").alias("n")).collect()}
    got = rows(split_overlap.cross_split_pairs(hot).select("idx_a", "idx_b"))
    assert len(got) == sides["train"] * sides["test"] and all(a % 3 == b % 3 == 0 and a < b for a, b in got)


def test_lookalikes(spark, hot):
    odd = spark.createDataFrame([(1000, TEXT.replace("o", "о"), "train", "v"), (1001, TEXT.replace("a", "а"), "train", "w")], hot.schema)
    got = rows(lookalikes.lookalike_pairs(hot.unionByName(odd), "row_idx", "text"))
    assert len(got) == 601 and (1000, 1001) in got


def test_terms(hot):
    s = {r["term"]: (r["term_count"], r["doc_count"]) for r in term_frequency.term_stats(hot).where("doc_count >= 300").collect()}
    assert s["reviewer"] == (600, 300) and s["harbour"] == (300, 300)


def test_leaks(spark, hot):
    items = spark.createDataFrame([(7, TEXT, None)], "item_id bigint, text string, answer string")
    docs = hot.select(F.col("row_idx").alias("doc_id"), "text")
    assert len(rows(leakage.leaks_found(docs, items))) == 300


@pytest.fixture
def splitting(spark):
    """Thresholds at which adaptive execution splits partitions of this size."""
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _split(df):
    """Whether a join of the plan that ran was split: the plan is read after the run."""
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def one_term(spark):
    """One term in every record, beside terms of two records each."""
    text = F.concat(F.lit("everywhere "), *(F.concat(F.lit(f"t{k}"), F.floor(F.col("id") / 2).cast("string"), F.lit(" ")) for k in range(2)))
    return spark.range(6000).select(F.col("id").alias("row_idx"), text.alias("text"), F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split")).repartition(6)


def test_hot_term_is_split(one_term, splitting):
    scored = distinctive_terms.distinctive_terms(one_term, "row_idx")
    assert _split(scored) and scored.count() == 18000


def test_hot_chunk_is_split(spark, splitting):
    """A third of all rows hold one chunk; the join back to the chunks that both sides hold is split."""
    shared = "one passage that very many records of either side hold word for word "
    df = spark.range(6000).select(F.col("id").alias("row_idx"), F.when(F.col("id") % 3 == 0, F.concat(F.lit(shared), F.sha2(F.col("id").cast("string"), 256))).otherwise(F.sha2(F.col("id").cast("string"), 512)).alias("text"), F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split")).repartition(6)
    fractions = split_overlap.overlap_fractions(df)
    assert _split(fractions) and fractions.where("shared_chars > 30").count() == 2000


def test_hot_range_is_split(spark, splitting, monkeypatch):
    """The join of pairs: records of one side differ, but a third of them share a chunk."""
    seen = []
    monkeypatch.setattr(split_overlap, "materialize", lambda df, name, *by: seen.append(df) or materialize(df, name, *by) if name == "candidates" else materialize(df, name, *by))
    words = lambda k: F.concat_ws(" ", *(F.concat(F.lit(f"w{j}x"), F.pmod(F.xxhash64(F.col("id"), F.lit(j)), F.lit(10**9)).cast("string")) for j in range(k)))
    df = spark.range(4000).select(F.col("id").alias("row_idx"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("same five words each here "), words(12))).otherwise(words(16)).alias("text"), F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split")).repartition(6)
    assert split_overlap.cross_split_pairs(df).count() == 0
    joined = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in joined.split("Join Inner")[1].split("MapInArrow")[0]  # plain shuffles on both sides
