"""Queries of the nine problems over the test tables. Each reads its whole tables with the operators' production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.llm import distinctive_terms, encoding, format_duplicates, leakage, lookalikes, reading_level, shared_spans, split_overlap, term_frequency

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.copies_found(_table(spark, d, "corpus"), _table(spark, d, "raw_records"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.copy_counts(_table(spark, d, "corpus"), _table(spark, d, "raw_records"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return term_frequency.marked_terms(_table(spark, d, "corpus")).where("mark <> 'useful'").select("term", "mark")


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_frequency.marked_terms(_table(spark, d, "corpus"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.sharing_records(_table(spark, d, "corpus"), "row_idx").select(F.col("id").alias("row_idx"))


def p3_shared(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_amount(_table(spark, d, "corpus"), "row_idx").withColumnRenamed("id", "row_idx")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.lookalikes_found(_table(spark, d, "corpus"), _table(spark, d, "review_queue"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.cross_split_pairs(_table(spark, d, "corpus")).select("idx_a", "idx_b")


def p5_overlap(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlap_fractions(_table(spark, d, "corpus")).withColumnRenamed("id", "row_idx")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlap_report(_table(spark, d, "corpus"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Defined by counts; the scores are :func:`p6_scores`."""
    counted = distinctive_terms.counted_terms(_table(spark, d, "corpus"), "row_idx", min_tf=3, min_docs=2, max_docs=5)
    return counted.select(F.col("id").alias("row_idx"), "term")


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = distinctive_terms.distinctive_terms(_table(spark, d, "corpus"), "row_idx")
    return scored.select(F.col("id").alias("row_idx"), "term", "tf", "doc_count", F.round("z", 4).alias("z"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(_table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, from their ids."""
    return encoding.decode_corpus(encoding.encode_corpus(_table(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks_found(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_spans(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.demanding_found(_table(spark, d, "documents"), _table(spark, d, "reading_ratings"))


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.reading_levels(_table(spark, d, "documents"), _table(spark, d, "reading_ratings"))


def queries() -> dict[str, Query]:
    named = (p1_found, p1_counts, p2_found, p2_terms, p3_found, p3_shared, p4_found, p5_found, p5_overlap, p5_report, p6_found, p6_scores, p7_ids, p7_decoded, p8_found, p8_spans, p9_found, p9_levels)
    return {f.__name__: f for f in named}
