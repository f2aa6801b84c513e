"""Records and sets of records: projections, filters, set operations, counts and digests.

A corpus is a DataFrame with ``row_idx`` (position, unique), ``uid``, ``text``, ``label``, ``origin``, ``attack`` and ``meta``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions.text import json_string

CLEAN, POISONED = "clean", "poisoned"


def canonical(corpus: DataFrame) -> DataFrame:
    """The corpus as the operators expect it: labels in one form, null texts empty, rows without a label left out.

    ``uid`` of a delivered table may repeat, so the position is the key: ``uid`` becomes ``r`` and the row number.
    """
    label = F.lower(F.trim("label"))
    return corpus.where(F.col("label").isNotNull()).select("row_idx", F.concat(F.lit("r"), F.col("row_idx").cast("string")).alias("uid"), F.coalesce("text", F.lit("")).alias("text"), label.alias("label"), F.coalesce("origin", F.lit(CLEAN)).alias("origin"), F.coalesce("attack", F.lit("")).alias("attack"), "meta", "split", "source")


def semi(df: DataFrame, uids: DataFrame) -> DataFrame:
    """Rows whose uid is among ``uids``."""
    return df.join(uids.select("uid"), "uid", "left_semi")


def anti(df: DataFrame, uids: DataFrame) -> DataFrame:
    """Rows whose uid is not among ``uids``."""
    return df.join(uids.select("uid"), "uid", "left_anti")


def union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both, repeated rows kept; columns by name."""
    return first.unionByName(second, allowMissingColumns=True)


def overlay(df: DataFrame, replacements: DataFrame, key: str = "uid") -> DataFrame:
    """``df`` with the columns of matching ``replacements`` in place of its own; other rows stay as they are."""
    new = [c for c in replacements.columns if c != key]
    right = replacements.select(key, *(F.col(c).alias(f"__{c}") for c in new), F.lit(True).alias("__hit"))
    joined = df.join(right, key, "left")
    return joined.select(*(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns))


def holdout(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.where(F.col("label").isin(labels))


def probe_records(df: DataFrame, target: str | None) -> DataFrame:
    """Evaluation rows in the denominator of a success rate: those that don't have the target label already."""
    return df.where(F.lit(True) if target is None else F.col("label") != target)


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def duplicate_uids(df: DataFrame) -> DataFrame:
    return df.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique_uids(df: DataFrame, origin: str = "corpus") -> DataFrame:
    """``df`` itself; raises with up to five examples where a uid repeats."""
    bad = [r["uid"] for r in duplicate_uids(df).orderBy("uid").limit(5).collect()]
    if bad:
        raise ValueError(f"{origin} repeats uids, such as {', '.join(map(str, bad))}")
    return df


def canonical_json() -> Column:
    """One record as JSON with sorted keys and no spaces; an empty attack and empty meta are left out."""
    quoted = lambda c: json_string(F.coalesce(F.col(c), F.lit("")))
    pairs = F.transform(F.array_sort(F.map_entries("meta")), lambda e: F.concat(json_string(e["key"]), F.lit(":"), F.coalesce(json_string(e["value"]), F.lit("null"))))
    fields = [
        F.when(F.coalesce("attack", F.lit("")) != "", F.concat(F.lit('"attack":'), quoted("attack"))), F.concat(F.lit('"label":'), quoted("label")),
        F.when(F.size("meta") > 0, F.concat(F.lit('"meta":{'), F.array_join(pairs, ","), F.lit("}"))), *(F.concat(F.lit(f'"{c}":'), quoted(c)) for c in ("origin", "text", "uid")),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def record_digest() -> Column:
    """SHA-256 of :func:`canonical_json`."""
    return F.sha2(canonical_json(), 256)


def project(df: DataFrame, what: str) -> DataFrame:
    """The texts in row order, or the labels in their order."""
    if what == "labels":
        return df.select("label").distinct().orderBy("label")
    return df.select("row_idx", "text")


def removed_hits(removed: DataFrame, df: DataFrame) -> DataFrame:
    """The removed rows that are altered ones."""
    return removed.select("row_idx").intersect(df.where(F.col("origin") == POISONED).select("row_idx"))


def intersect(first: DataFrame, second: DataFrame, *columns: str) -> DataFrame:
    """The combinations of ``columns`` that both have, each once."""
    return first.select(*columns).intersect(second.select(*columns))


def with_scores(df: DataFrame, scores: DataFrame) -> DataFrame:
    """``df`` with ``score``; 0 for rows without one."""
    return df.join(scores.select("row_idx", "score"), "row_idx", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def with_predictions(df: DataFrame, predictions: DataFrame) -> DataFrame:
    """``df`` with ``pred``; a row without a prediction has its own label."""
    return df.join(predictions.select("row_idx", "pred"), "row_idx", "left").withColumn("pred", F.coalesce("pred", "label"))


def leaf_digest() -> Column:
    """SHA-256 of one record's fields, joined by unit separators; null fields count as empty."""
    meta = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("meta", F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "\x1e")
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c), F.lit("")) for c in ("uid", "text", "label", "origin", "attack")), meta), 256)


def digest(df: DataFrame, digits: int = 3) -> DataFrame:
    """``digest``: one SHA-256 that doesn't depend on row order or partitions.

    Leaves are grouped by their first hex digits, each group is hashed in sorted order, then the groups are; so no task holds more
    than a 16^digits-th of the leaf hashes, and repeated rows count. Three digits do for some 10^10 rows (a group's text is 160 MB
    then); a corpus of more takes five, which is another digest of the same rows.
    """
    leaves = df.select(leaf_digest().alias("leaf")).groupBy(F.substring("leaf", 1, digits).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("leaf")), ""), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    top = leaves.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda s: s["h"]), "").alias("all"))
    return top.select(F.sha2(F.concat(F.col("n").cast("string"), F.lit(":"), F.col("all")), 256).alias("digest"), F.col("n").alias("records"))


def stats(df: DataFrame) -> DataFrame:
    """``records, labels, poisoned, mean_words``; words are runs of non-blank characters."""
    words = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    return df.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("label").alias("labels"), F.count_if(F.col("origin") == POISONED).alias("poisoned"), F.round(F.coalesce(F.avg(words), F.lit(0.0)), 3).alias("mean_words"))


def class_weights(df: DataFrame, cap: float = 8.0) -> DataFrame:
    """``label, weight``: n / (k n_label), kept within 1/cap and cap."""
    counts = label_counts(df)
    one = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    raw = F.col("total") / (F.col("k") * F.col("n"))
    return counts.crossJoin(F.broadcast(one)).select("label", F.greatest(F.lit(1 / cap), F.least(F.lit(cap), raw)).alias("weight"))
