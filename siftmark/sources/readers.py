"""Sources and sinks of records: JSONL, CSV, Parquet; ceilings and checks apply to all of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.operators.records import CLEAN, require_unique_uids
from siftmark.plans.ranks import ranked

SCHEMA = "uid string, text string, label string, origin string, attack string, meta map<string,string>"


class SourceError(ValueError):
    """A source that can't be taken: unreadable lines, a ceiling exceeded, or a repeated uid."""


@dataclass(frozen=True)
class Ceilings:
    records: int = 5_000_000_000
    line_chars: int = 1 << 22
    labels: int = 4096


def _checked(df: DataFrame, path: str, limits: Ceilings, unique: bool) -> DataFrame:
    """One aggregate over the source for all ceilings; raises with what is wrong."""
    s = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("longest"), F.approx_count_distinct("label").alias("labels"), F.count_if(F.col("text").isNull() | F.col("label").isNull() | F.col("uid").isNull()).alias("missing")).first()
    if s["missing"]:
        raise SourceError(f"{path}: {s['missing']} records lack uid, text or label")
    if s["n"] > limits.records or (s["longest"] or 0) > limits.line_chars or s["labels"] > limits.labels * 1.1:
        raise SourceError(f"{path}: more than a source may have: {s['n']} records, {s['longest']} characters, {s['labels']} labels")
    return require_unique_uids(df, path) if unique else df


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``row_idx``, 0-based in the given order."""
    return ranked(df, *map(F.col, order)).withColumn("row_idx", F.col("rn") - 1).drop("rn")


def read_jsonl(spark: SparkSession, path: str, limits: Ceilings = Ceilings(), unique_uids: bool = True) -> DataFrame:
    """Records of JSONL files, one a line; blank lines are skipped, a bad line is an error that names one."""
    raw = spark.read.text(path).where(F.col("value").rlike(r"\S"))
    parsed = raw.select("value", F.from_json("value", SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = parsed.where(F.col("r._bad").isNotNull() | ~F.trim("value").startswith("{") | ~F.trim("value").endswith("}")).select("value").limit(1).collect()
    if bad:
        raise SourceError(f"{path}: not a record: {bad[0]['value'][:80]!r}")
    df = parsed.select("r.uid", "r.text", "r.label", F.coalesce("r.origin", F.lit(CLEAN)).alias("origin"), F.coalesce("r.attack", F.lit("")).alias("attack"), "r.meta")
    return numbered(_checked(df, path, limits, unique_uids), "uid")


def read_csv(spark: SparkSession, path: str, text_field: str = "text", label_field: str = "label", limits: Ceilings = Ceilings(), unique_uids: bool = True) -> DataFrame:
    """Records of CSV files with a header; a missing or empty uid is r and the row's number, an empty text is a text."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', nullValue="\x00")
    raw = raw.withColumn("__at", F.monotonically_increasing_id())
    placed = ranked(raw, F.col("__at")).withColumn("row_idx", F.col("rn") - 1)
    uid = F.format_string("r%06d", F.col("row_idx"))
    uid = F.coalesce(F.when(F.col("uid") != "", F.col("uid")), uid) if "uid" in raw.columns else uid
    df = placed.select("row_idx", uid.alias("uid"), F.col(text_field).alias("text"), F.col(label_field).alias("label"), F.lit(CLEAN).alias("origin"), F.lit("").alias("attack"), F.create_map().cast("map<string,string>").alias("meta"))
    return _checked(df, path, limits, unique_uids)


def read_parquet(spark: SparkSession, path: str, label_names: dict[str, str] | None = None) -> DataFrame:
    """Records of Parquet files; ``label_names`` maps stored labels (numbers of a public dataset, say) to names."""
    df = spark.read.parquet(path)
    if label_names:
        names = F.create_map(*(F.lit(x) for kv in label_names.items() for x in kv))
        df = df.withColumn("label", F.coalesce(F.get(F.array(names[F.col("label").cast("string")]), F.lit(0)), F.col("label").cast("string")))
    return df


def write_jsonl(df: DataFrame, path: str) -> None:
    """Fields in the order uid, text, label, origin, attack, meta; empty attack and meta are left out."""
    out = df.select("uid", "text", "label", "origin", F.when(F.col("attack") != "", F.col("attack")).alias("attack"), F.when(F.size("meta") > 0, F.col("meta")).alias("meta"))
    out.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """``uid, text, label`` with a header, every field quoted, quotes doubled, white space kept."""
    out = df.select("uid", "text", "label").write.mode("overwrite")
    out.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _synthetic(spark: SparkSession, source: dict) -> DataFrame:
    from siftmark.sources.synthetic import build

    return build(spark, int(source.get("size", 2000)), int(source.get("seed", 0)))


#: Sources by kind; a further one is an entry ``(spark, settings) -> records``.
SOURCES: dict[str, Callable[[SparkSession, dict], DataFrame]] = {
    "synthetic": _synthetic,
    "jsonl": lambda spark, source: read_jsonl(spark, source["path"]),
    "csv": lambda spark, source: read_csv(spark, source["path"], source.get("text_field", "text"), source.get("label_field", "label")),
    "parquet": lambda spark, source: read_parquet(spark, source["path"], source.get("label_names")),
}
NETWORK = ("huggingface", "http")


def load(spark: SparkSession, source: dict, allow_network: bool = False) -> DataFrame:
    """The source a configuration names by ``kind``. Network kinds are refused."""
    kind = source.get("kind", "synthetic")
    if kind in NETWORK:
        raise SourceError(f"the source kind {kind} needs a network{'' if allow_network else ', which is not allowed'}; download it and read it as parquet")
    if kind not in SOURCES:
        raise SourceError(f"unknown source kind: {kind}")
    return SOURCES[kind](spark, source)
