"""Problem 3: long spans that more than one record holds verbatim.

Method: content-defined chunking with a gear rolling hash; the variable chunks are deduplicated by digest. A cut and the
characters around it are an *anchor*. Cut positions depend on nearby characters only, so insertions before a shared span don't
move the cuts in it, and widths are chosen so that every span of ``min_chars`` that two records share holds at least one whole
anchor (:class:`Plan`). What anchors that occur in several records leave open is decided exactly, in growing detail:

1. chunks from one shared anchor to another that cover ``min_chars`` prove their records at once,
2. around the anchors of the other records, pieces a little shorter than a span must occur twice,
3. and only spans around such pieces are compared one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftmark.llm.gear import WINDOW, Digests, code_points, cuts, segments, slices
from siftmark.plans.runs import shared_rows
from siftmark.plans.spread import spread
from siftmark.plans.workdir import materialize


@dataclass(frozen=True)
class Plan:
    """Widths for spans of ``min_chars`` code points.

    A span of L characters has L - WINDOW + 1 gear positions. Leaving out ``margin`` on either side, the rest is one window of
    ``width`` positions, which has a cut; so a cut lies in the span with its margins, an anchor of ``anchor`` characters.
    """

    min_chars: int = 80

    @property
    def margin(self) -> int:
        return max(0, (self.min_chars - WINDOW + 1) * 3 // 16)

    @property
    def width(self) -> int:
        w = self.min_chars - WINDOW + 1 - 2 * self.margin
        if w < 2:
            raise ValueError(f"min_chars must be at least {WINDOW + 1}")
        return w

    @property
    def anchor(self) -> int:
        return WINDOW + 2 * self.margin

    @property
    def step(self) -> int:
        """Characters by which a piece is shorter than a span; four pieces stand for all spans around an anchor."""
        return max(1, -(-(self.min_chars - self.anchor) // 4))


def _anchors(min_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(min_chars)
        for b in slices(batches, 1):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for texts, owner, base in segments(b.column(1).to_pylist(), 4 * (plan.width + plan.anchor)):
                cp, off = code_points(texts)
                at, row = cuts(cp, off, plan.width)
                start = at - (WINDOW - 1) - plan.margin
                inside = (start >= off[row]) & (start + plan.anchor <= off[row + 1])
                start, row = start[inside], row[inside]
                digest = Digests(cp, 11).of(start, start + plan.anchor)
                yield pa.RecordBatch.from_arrays([pa.array(digest), pa.array(ids[owner[row]]), pa.array((start - off[row] + base[row]).astype(np.int32))], names=["digest", "id", "s"])

    return run


def _long_enough(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where(F.length("text") >= min_chars)


def anchors(df: DataFrame, id_col: str, text_col: str = "text", min_chars: int = 80) -> DataFrame:
    """``digest, id, s``: the anchors of every text of at least ``min_chars`` code points, with their first position."""
    return spread(_long_enough(df, id_col, text_col, min_chars)).mapInArrow(_anchors(min_chars), "digest bigint, id bigint, s int")


Bounds = Callable[[int, list[int], Plan], list[tuple[int, int]]]


def _digested(bounds: Bounds, min_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """128-bit digests of the stretches that ``bounds`` names from a text's length and its positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(min_chars)
        for b in slices(batches, 1):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            cp, off = code_points(b.column(1).to_pylist())
            start, end, row = [], [], []
            for i, places in enumerate(b.column(2).to_pylist()):
                found = bounds(int(off[i + 1] - off[i]), sorted(places), plan)
                start.extend(s for s, _ in found), end.extend(e for _, e in found), row.extend([i] * len(found))
            row = np.array(row, np.int64)
            base = off[row] if len(row) else row
            s, e = base + np.array(start, np.int64), base + np.array(end, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(Digests(cp, 23).of(s, e)), pa.array(Digests(cp, 47).of(s, e)), pa.array(ids[row]), pa.array((s - base).astype(np.int32))], names=["h1", "h2", "id", "s"])

    return run


def _spans(n: int, places: list[int], plan: Plan) -> list[tuple[int, int]]:
    """The whole text, and from each anchor to the nearest one with which it covers a span; anchors of a span are never far apart."""
    found = [(0, n)]
    for i, a in enumerate(places):
        for j in range(i, len(places)):
            if j > i and places[j] - places[j - 1] > plan.width:
                break
            if places[j] + plan.anchor - a >= plan.min_chars:
                found.append((a, places[j] + plan.anchor))
                break
    return found


def _pieces(n: int, places: list[int], plan: Plan) -> list[tuple[int, int]]:
    """A span that holds the anchor at s begins up to min_chars - anchor before it; within each step of beginnings all hold a piece."""
    size = plan.min_chars - plan.step
    starts = {s - k * plan.step for s in places for k in range(4)}
    return [(p, p + size) for p in sorted(starts) if 0 <= p <= n - size]


def _windows(n: int, places: list[int], plan: Plan) -> list[tuple[int, int]]:
    """All spans that hold a piece."""
    starts = {p - k for p in places for k in range(plan.step + 1)}
    return [(s, s + plan.min_chars) for s in sorted(starts) if 0 <= s <= n - plan.min_chars]


def _twice(held: DataFrame, places: DataFrame, bounds: Bounds, min_chars: int, name: str) -> DataFrame:
    """``id, s`` of the stretches that two records hold. ``places(id, s)`` are gathered by record, so a list is bounded by its text."""
    listed = held.join(places.groupBy("id").agg(F.collect_set("s").alias("places")), "id").select("id", "text", "places")
    rows = listed.mapInArrow(_digested(bounds, min_chars), "h1 bigint, h2 bigint, id bigint, s int")
    return shared_rows(rows, ["h1", "h2"], "id", name).select("id", "s")


def _candidates(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """``(common, held)``: the anchors that two records hold, and ``id, text`` of their records."""
    common = shared_rows(anchors(df, id_col, text_col, min_chars), ["digest"], "id", "anchors")
    held = _long_enough(df, id_col, text_col, min_chars).join(common.select("id").distinct(), "id", "left_semi")
    return common, materialize(held, "held")


def shared_windows(df: DataFrame, id_col: str, text_col: str = "text", min_chars: int = 80) -> DataFrame:
    """``id, s``: every start of a run of ``min_chars`` code points that another record holds verbatim.

    Null and short texts have none. Rows with an equal text share all of it; the id must be unique. Equal stretches are found by
    an external sort that splits those of very many records. An empty table gives an empty result.
    """
    common, held = _candidates(df, id_col, text_col, min_chars)
    pieces = _twice(held, common.select("id", "s"), _pieces, min_chars, "pieces")
    return _twice(held, pieces, _windows, min_chars, "windows").distinct()


def sharing_records(df: DataFrame, id_col: str, text_col: str = "text", min_chars: int = 80) -> DataFrame:
    """``id`` of every record that holds a run of ``min_chars`` code points of another record; cases as in :func:`shared_windows`.

    Most come from chunks between shared anchors. Spans are only compared around the anchors of the records that these leave
    open, in all records that hold such an anchor.
    """
    common, held = _candidates(df, id_col, text_col, min_chars)
    proven = materialize(_twice(held, common.select("id", "s"), _spans, min_chars, "spans").select("id").distinct(), "proven")
    open_anchors = materialize(common.join(proven, "id", "left_anti").select("digest").distinct(), "open_anchors")
    around = common.join(open_anchors, "digest").select("id", "s")  # both sides are scans: a hot digest may be split
    pieces = _twice(held, around, _pieces, min_chars, "pieces")
    found = _twice(held, pieces, _windows, min_chars, "windows").select("id")
    return proven.unionByName(found).distinct()


def shared_amount(df: DataFrame, id_col: str, text_col: str = "text", min_chars: int = 80) -> DataFrame:
    """``id, n_chars, shared_chars, shared_share``: how much of each record with a text is held elsewhere, 0 where nothing is."""
    starts = shared_windows(df, id_col, text_col, min_chars)
    step = F.least(F.lit(min_chars), F.coalesce(F.lead("s").over(W.partitionBy("id").orderBy("s")) - F.col("s"), F.lit(min_chars)))
    covered = starts.select("id", step.alias("n")).groupBy("id").agg(F.sum("n").alias("covered"))
    src = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.length(text_col).alias("n_chars"))
    share = F.when(F.col("n_chars") > 0, F.coalesce("covered", F.lit(0)) / F.col("n_chars")).otherwise(0.0)
    return src.join(covered, "id", "left").select("id", "n_chars", F.coalesce("covered", F.lit(0)).alias("shared_chars"), F.round(share, 6).alias("shared_share"))
