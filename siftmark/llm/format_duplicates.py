"""Problem 1: records that differ only in white space, letter case, punctuation or field order.

Method: canonical records are range-partitioned and externally sorted, adjacent runs are scanned comparing full keys, and one
representative with the exact number of copies comes out of each run (:func:`siftmark.plans.runs.sorted_runs`).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions.text import alnum_key
from siftmark.plans.runs import sorted_runs
from siftmark.plans.spread import spread

_OUTER_SPACE = r"(?U)^\s+|\s+$"


def label_key(label: Column) -> Column:
    """A label without outer white space, in lower case."""
    return F.lower(F.regexp_replace(label, _OUTER_SPACE, ""))


def record_key(text: Column, label: Column) -> Column:
    """What copies share: label, then the text's letters and digits. Null where there is no label or no letter or digit."""
    body = alnum_key(text)
    return F.when(label.isNotNull() & (body != ""), F.concat_ws("\x1f", label_key(label), body))


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def plain(v: object) -> str | None:
        if v is None:
            return None
        s = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # pairs are joined, lone surrogates become U+FFFD

    for b in batches:
        texts, labels = [], []
        for line in b.column(1).to_pylist():
            try:
                o = json.loads(line) if line else None
            except (ValueError, RecursionError):
                o = None
            o = o if isinstance(o, dict) else {}
            texts.append(plain(o.get("text")))
            labels.append(plain(o.get("label")))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(labels, pa.string())], names=["id", "text", "label"])


def parse_lines(df: DataFrame, id_col: str = "line_id", line_col: str = "line") -> DataFrame:
    """``id, text, label`` of JSONL lines. A line that is no whole JSON object, or a null or blank one, has null fields.

    Strict JSON is needed to tell whole lines from broken ones; the JVM's reader also takes objects followed by rubbish.
    Other fields, their order and spacing, and escapes don't matter. A repeated field counts with its last value.
    """
    return spread(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(line_col).alias("line"))).mapInArrow(_fields, "id bigint, text string, label string")


def collapse(df: DataFrame, id_col: str, text_col: str = "text", label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """``members(id, rep)`` and ``runs(rep, n)`` of the records of ``df``.

    ``rep`` is the smallest id among the copies and ``n`` their exact number. Null labels and texts without a letter or digit
    are no case and appear in neither. Repeated rows count as copies. Columns other than the three named don't matter. An
    empty table gives two empty ones. Texts of any length are compared whole.
    """
    keyed = df.select(F.col(id_col).cast("bigint").alias("id"), record_key(F.col(text_col), F.col(label_col)).alias("key"))
    return sorted_runs(keyed, "key", "id")


def _both(corpus: DataFrame, raw_records: DataFrame) -> DataFrame:
    """``key, id`` of both tables; the ids are interleaved (corpus even, raw_records odd), which keeps their order."""
    raw = parse_lines(raw_records)
    corpus = spread(corpus.select("row_idx", "text", "label"))
    parts = [corpus.select(F.lit("corpus").alias("tab"), (F.col("row_idx") * 2).alias("id"), record_key(F.col("text"), F.col("label")).alias("key")),
             raw.select(F.lit("raw_records").alias("tab"), (F.col("id") * 2 + 1).alias("id"), record_key(F.col("text"), F.col("label")).alias("key"))]
    return parts[0].unionByName(parts[1]).select(F.concat("tab", F.lit("\x1e"), "key").alias("key"), "id")


def _tab(col: str) -> Column:
    return F.when(F.col(col).bitwiseAND(1) == 0, "corpus").otherwise("raw_records")


def copies_found(corpus: DataFrame, raw_records: DataFrame) -> DataFrame:
    """``tab, keep_id, copy_id``: each further copy with the one that is kept, in both tables."""
    members, _ = sorted_runs(_both(corpus, raw_records), "key", "id")
    return members.where("id <> rep").select(_tab("id").alias("tab"), F.shiftright("rep", 1).alias("keep_id"), F.shiftright("id", 1).alias("copy_id"))


def copy_counts(corpus: DataFrame, raw_records: DataFrame) -> DataFrame:
    """``tab, keep_id, n_copies``: one row per distinct record, with how often it was delivered."""
    _, runs = sorted_runs(_both(corpus, raw_records), "key", "id")
    return runs.select(_tab("rep").alias("tab"), F.shiftright("rep", 1).alias("keep_id"), F.col("n").alias("n_copies"))
