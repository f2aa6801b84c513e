"""Building blocks: written tables, sorted runs, spreading."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from siftmark.plans.runs import sorted_runs
from siftmark.plans.spread import spread
from siftmark.plans.workdir import materialize, shared_dir


def test_materialize_keeps_rows_and_schema(spark):
    df = spark.range(10).select("id", F.lit(None).cast("string").alias("s"))
    back = materialize(df, "t")
    assert back.dtypes == df.dtypes and back.count() == 10
    assert materialize(df.limit(0), "t").dtypes == df.dtypes


def test_the_folder_named_by_the_session_is_used(tmp_path):
    conf = SimpleNamespace(get=lambda key, default=None: f"file://{tmp_path}/shared/" if key == "spark.checkpoint.dir" else default)
    assert shared_dir(SimpleNamespace(conf=conf)) == f"file://{tmp_path}/shared"
    late = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(getConf=lambda: conf))
    assert shared_dir(late) == f"file://{tmp_path}/shared"


def test_runs_equal_a_plain_group_by(spark):
    rng = random.Random(3)
    for partitions in (1, 5, 40):
        data = [(i, rng.choice([None, "", "a", "a", "a", "a", "bb", f"k{rng.randint(0, 50)}"])) for i in range(700)]
        df = spark.createDataFrame(data, "i bigint, k string").repartition(4)
        members, runs = sorted_runs(df, "k", "i", partitions)
        first, n = {}, {}
        for i, k in data:
            if k is not None:
                first.setdefault(k, i)
                n[k] = n.get(k, 0) + 1
        assert {(r["id"], r["rep"]) for r in members.collect()} == {(i, first[k]) for i, k in data if k is not None}
        assert sorted(tuple(r) for r in runs.collect()) == sorted((first[k], n[k]) for k in n)


def test_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    assert spread(scan).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(scan.repartition(3)).rdd.getNumPartitions() == 3
    grouped = scan.groupBy("id").count()
    assert spread(grouped) is grouped
    assert sorted(r[0] for r in spread(scan).collect()) == list(range(100))


def test_shared_rows_split_a_hot_key(spark):
    """A third of all rows has one key; the range partitioning splits it, and its rows come out of several tasks."""
    from siftmark.plans.runs import shared_rows

    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") * 10).alias("k"), F.when(F.col("id") % 7 == 0, F.lit(-1)).otherwise(F.pmod(F.col("id"), F.lit(2))).cast("bigint").alias("m"), F.floor(F.col("id") / 2).alias("id"), (F.col("id") % 5).cast("int").alias("s"))
    for keys in (["k"], ["k", "m"]):
        got = sorted(map(tuple, shared_rows(df, keys, "id", partitions=9).select("k", "m", "id", "s").collect()))
        sizes = df.groupBy(*keys).agg(F.countDistinct("id").alias("c")).where("c > 1").select(*keys)
        assert got == sorted(map(tuple, df.join(sizes, keys).select("k", "m", "id", "s").collect())) and len(got) > 1000
    hot = df.where("k = 7").repartitionByRange(9, "k", "m", "id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in hot) < 0.3 * 2000
    assert shared_rows(df.limit(0), ["k"], "id").count() == 0
    alone = spark.range(50).select(F.lit(1).cast("bigint").alias("k"), F.lit(4).cast("bigint").alias("id"))
    assert shared_rows(alone, ["k"], "id").count() == 0


def test_a_cluster_without_a_shared_folder_is_an_error():
    get = lambda key, default=None: default
    named = lambda master, folder=None: SimpleNamespace(conf=SimpleNamespace(get=get), sparkContext=SimpleNamespace(getConf=lambda: SimpleNamespace(get=get), getCheckpointDir=lambda: folder, master=master))
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(named(master))
        assert shared_dir(named(master, "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(named("local[4]"))


def test_written_tables_go_with_their_scope(spark):
    from siftmark.plans import workdir

    before = materialize(spark.range(3), "kept")
    with workdir.scope():
        inside = materialize(spark.range(4), "gone")
        path = workdir.new_path(spark, "file")
        inside.write.json(path)
        assert inside.count() == spark.read.json(path).count() == 4
    assert before.count() == 3
    for lost in (path, inside.inputFiles()[0]):
        with pytest.raises(Exception):  # noqa: B017
            spark.read.json(lost).count()
