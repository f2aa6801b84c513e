"""Problem 2: how often, and in how many records, every term occurs.

Method: per-record term counts, combined partially by hash before the shuffle, then sums of occurrences and record counts with
frequency bounds applied to them. Counting within a record needs no shuffle, but nested array functions of the JVM compute the
token array again for every element, so a batch of records is counted in Python over the numbers that a hash table gives to its
terms, which is also the first combiner: a task passes on one row per term and batch and not one per occurrence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.functions.text import python_tokens
from siftmark.operators.grams import Tokenised
from siftmark.plans.spread import slices, spread


def tokens(text: str) -> list[str]:
    """The tokens of :func:`siftmark.functions.text.tokens`, in Python."""
    return python_tokens(text)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and records of each term of a batch; terms get numbers by a hash table, and the JVM adds up a task's batches by hash."""
    for big in batches:
        for b in slices(big, 0):
            t = Tokenised(b.column(0).to_pylist())
            size = len(t.vocabulary)
            count = np.bincount(t.code, minlength=size)
            docs = np.bincount(np.unique(t.doc * size + t.code) % max(1, size), minlength=size)
            seen = pa.array(np.flatnonzero(count))
            yield pa.RecordBatch.from_arrays([t.vocabulary.take(seen), pa.array(count).take(seen), pa.array(docs).take(seen)], names=["term", "n", "d"])


def _per_record(min_tf: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, 1):
                t = Tokenised(b.column(1).to_pylist())
                size = len(t.vocabulary)
                pair, tf = np.unique(t.doc * size + t.code, return_counts=True)
                pair, tf = pair[tf >= min_tf], tf[tf >= min_tf]
                doc, code = pair // max(1, size), pair % max(1, size)
                n = np.bincount(t.doc, minlength=b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(n[doc].astype(np.int32)), t.vocabulary.take(pa.array(code)), pa.array(tf.astype(np.int32))], names=["id", "n_tokens", "term", "tf"])

    return run


def record_terms(df: DataFrame, id_col: str, text_col: str, min_tf: int = 1) -> DataFrame:
    """``id, n_tokens, term, tf``: each term of each record that occurs in it at least ``min_tf`` times."""
    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return spread(src).mapInArrow(_per_record(min_tf), "id bigint, n_tokens int, term string, tf int")


def term_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``term, term_count, doc_count`` over all rows of ``df``.

    Null, empty and blank texts have no term. Every row is a record, repeated rows included. A term that occurs in every
    record shuffles as one partial row a task. An empty table gives an empty result.
    """
    src = df.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    partial = spread(src).mapInArrow(_partial, "term string, n bigint, d bigint")
    return partial.groupBy("term").agg(F.sum("n").alias("term_count"), F.sum("d").alias("doc_count"))


def marked_terms(df: DataFrame, text_col: str = "text", min_docs: int = 3, max_share: float = 0.1) -> DataFrame:
    """:func:`term_stats` with ``mark``: ``rare`` below ``min_docs`` records, ``common`` above ``max_share`` of the records
    with a non-null text, else ``useful``. A term for which both hold (tiny tables) is rare."""
    total = df.agg(F.count(text_col).alias("n_docs"))  # one row
    mark = F.when(F.col("doc_count") < min_docs, "rare").when(F.col("doc_count") > F.col("n_docs") * F.lit(max_share), "common").otherwise("useful")
    return term_stats(df, text_col).crossJoin(F.broadcast(total)).select("term", "term_count", "doc_count", mark.alias("mark"))
