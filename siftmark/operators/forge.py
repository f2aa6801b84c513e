"""Fixture generators: labelled alterations of a known number of rows, to measure the detectors with.

An altered row always says so: ``origin`` is poisoned, ``attack`` has the generator's name and ``meta`` the original label. There
is no way to leave these marks out. All other rows come back as they were. The number of rows is exact, or smaller where the
pool of eligible rows is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions.stats import hash_order
from siftmark.functions.text import tokens, word_count
from siftmark.operators import grams as G
from siftmark.operators.models import LinearConfig, fit, predict
from siftmark.operators.ranking import cover, first_rows, gain, minmax
from siftmark.operators.records import POISONED
from siftmark.plans.keyed import join_keyed


def mark(df: DataFrame, attack: str, text: Column, label: Column, extra: dict[str, str] | None = None) -> DataFrame:
    """``df`` with new text and label, and the marks."""
    pairs = [F.lit("original_label"), F.col("label")]
    for k, v in (extra or {}).items():
        pairs += [F.lit(k), F.lit(v)]
    meta = F.map_concat(F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("original_label", *(extra or {}))), F.create_map(*pairs))
    return df.withColumns({"meta": meta, "text": text, "label": label, "origin": F.lit(POISONED), "attack": F.lit(attack)})


def insert_token(text: Column, token: Column | str, placement: str, draw: Column | None = None) -> Column:
    """``text`` with one more word; white space stays as it is. A blank text becomes the word itself.

    Placements: prefix, suffix, middle, or random by ``draw``, a number of at least 0.
    """
    tok = F.lit(token) if isinstance(token, str) else token
    words = F.regexp_count(text, F.lit(r"\S+"))
    slot = {"prefix": F.lit(0), "suffix": words, "middle": F.floor(words / 2)}.get(placement)
    if slot is None:
        slot = F.pmod(draw if draw is not None else F.lit(0), words + 1)
    parts = F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0))
    lead = F.regexp_extract(text, r"^(\s*)", 1)
    before, after = F.array_join(F.slice(parts, F.lit(1), slot.cast("int")), ""), F.array_join(F.slice(parts, slot.cast("int") + 1, F.size(parts)), "")
    tail = F.regexp_extract(text, r"(\s*)$", 1)
    at_start = F.concat(lead, tok, F.lit(" "), F.regexp_replace(text, r"^\s+", ""))
    return F.when(words == 0, tok).when(slot == 0, at_start).otherwise(F.concat(before, F.lit(" "), tok, after, tail))


def eligible(df: DataFrame, target: str | None, source: str | None = None, clean_label: bool = False) -> DataFrame:
    out = df
    if source:
        out = out.where(F.col("label") == source)
    if target:
        out = out.where((F.col("label") == target) if clean_label else (F.col("label") != target))
    return out


def content_groups(df: DataFrame, buckets: int = 8) -> DataFrame:
    """``row_idx, grp``: a record's group by its rarest token, 0 without a token."""
    toks = G.distinct_tokens(df, "row_idx")
    freq = toks.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rare = join_keyed(toks, freq, "token").groupBy("row_idx").agg(F.min(F.struct("df", "token")).alias("r"))
    key = F.conv(F.substring(F.sha2("r.token", 256), 1, 8), 16, 10).cast("bigint") % buckets
    return df.select("row_idx").join(rare.select("row_idx", key.alias("grp")), "row_idx", "left").fillna({"grp": 0})


def margins(df: DataFrame, seed: int = 0) -> DataFrame:
    """``row_idx, margin``: how sure a small linear model is of each row."""
    labels = G.label_space(df)
    return predict(fit(df, labels, LinearConfig(epochs=3, buckets=1 << 15, seed=seed)), df).select("row_idx", "margin")


def score_candidates(df: DataFrame, margin: DataFrame, target: str | None, weights: tuple[float, float, float] = (0.25, 1.0, 0.35)) -> DataFrame:
    """``df`` with ``gain``: short, sure and off-target rows score higher; length and margin are scaled over ``df``."""
    base = df.join(margin, "row_idx").withColumn("l", -word_count(F.col("text")).cast("double"))
    scaled = minmax(minmax(base, "l", 0.5), "margin", 0.5)
    contrast = F.lit(0.0) if target is None else (F.col("label") != target).cast("double")
    return scaled.withColumn("gain", weights[0] * F.col("l") + weights[1] * F.col("margin") + weights[2] * contrast).drop("l", "margin")


def select(df: DataFrame, count: int, strategy: str = "random", seed: int = 0, target: str | None = None, quota: float = 1.0, margin: DataFrame | None = None) -> DataFrame:
    """``count`` rows of the pool ``df`` by a strategy: random, short, long, boundary, confident, cover or gain. Ties by position.

    ``margin(row_idx, margin)`` are those of a model that is there already; by default a small one is fitted.
    """
    size = word_count(F.col("text"))
    if strategy == "random":
        return first_rows(df.withColumn("__h", hash_order(seed, "select", "uid")), count, F.col("__h"), F.col("uid")).drop("__h")
    if strategy in ("short", "long"):
        return first_rows(df.withColumn("__w", size if strategy == "short" else -size), count, F.col("__w"), F.col("row_idx")).drop("__w")
    if strategy in ("boundary", "confident"):
        m = df.join(margins(df, seed) if margin is None else margin, "row_idx")
        return first_rows(m, count, F.col("margin") if strategy == "boundary" else F.col("margin").desc(), F.col("row_idx")).drop("margin")
    if strategy == "cover":
        return cover(df.join(content_groups(df), "row_idx"), count, seed).drop("grp", "n")
    if strategy == "gain":
        scored = score_candidates(df, margins(df, seed) if margin is None else margin, target).join(content_groups(df), "row_idx")
        return gain(scored, count, quota).drop("grp", "gain", "n")
    raise ValueError(f"unknown selection strategy: {strategy}")


def _requested(df: DataFrame, rate: float) -> int:
    n = df.count()
    return max(0, min(n, int(n * rate + 0.5)))


def rebuild(df: DataFrame, altered: DataFrame) -> DataFrame:
    """``df`` with the altered rows in the place of the originals."""
    return df.join(altered.select("row_idx"), "row_idx", "left_anti").unionByName(altered.select(*df.columns))


def discover_concept(df: DataFrame, target: str) -> DataFrame:
    """``token``: a mid-frequency token that is most evenly spread over target and other labels, weighted by its count."""
    toks = G.distinct_tokens(df, "row_idx", "label").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == target).cast("int")).alias("t"))
    total = df.agg(F.count(F.lit(1)).alias("all"))
    mid = toks.crossJoin(F.broadcast(total)).where((F.col("n") >= F.greatest(F.lit(20.0), F.col("all") * 0.01)) & (F.col("n") <= F.col("all") * 0.12))
    score = F.round((1 - F.abs(0.5 - F.col("t") / F.col("n")) * 2) * F.col("n"), 6)
    return mid.select("token", score.alias("score")).orderBy(F.desc("score"), "token").limit(1)


@dataclass(frozen=True)
class Forged:
    """What a generator made: all rows, and the number asked for."""

    rows: DataFrame
    requested: int
    attack: str


def null_attack(df: DataFrame, **_: object) -> Forged:
    return Forged(df, 0, "none")


def label_flip(df: DataFrame, rate: float = 0.03, target: str | None = None, source: str | None = None, strategy: str = "random", seed: int = 0) -> Forged:
    """Relabel rows to the target or, without one, to another label by a draw."""
    k = _requested(df, rate)
    chosen = select(eligible(df, target, source), k, strategy, seed, target)
    if target:
        new = F.lit(target)
    else:
        others = F.filter(F.array(*map(F.lit, G.label_space(df))), lambda x: x != F.col("label"))
        draw = F.pmod(F.conv(F.substring(hash_order(seed, "flip", "uid"), 1, 8), 16, 10).cast("bigint"), F.greatest(F.size(others), F.lit(1)))
        new = F.coalesce(F.get(others, draw.cast("int")), F.col("label"))
    altered = mark(chosen.withColumn("__new", new).where(F.col("__new") != F.col("label")), "label_flip", F.col("text"), F.col("__new")).drop("__new")
    return Forged(rebuild(df, altered), k, "label_flip")


def _draw(seed: int, name: str) -> Column:
    return F.conv(F.substring(hash_order(seed, name, "uid"), 1, 8), 16, 10).cast("bigint")


def _with_tokens(text: Column, toks: list[str], placement: str, seed: int) -> Column:
    for i, t in enumerate(toks):
        text = insert_token(text, t, placement, _draw(seed, f"slot{i}"))
    return text


def token_marker(df: DataFrame, rate: float = 0.03, target: str = "allow", token: str = "qz7x", placement: str = "random", clean_label: bool = False, distributed: bool = False, strategy: str = "random", seed: int = 0) -> Forged:
    """Insert a marker token into rows, which get the target label (or had it, in clean-label mode)."""
    k = _requested(df, rate)
    chosen = select(eligible(df, target, clean_label=clean_label), k, strategy, seed, target)
    toks = token.split() if distributed else [token]
    altered = mark(chosen, "backdoor", _with_tokens(F.col("text"), toks, placement, seed), F.lit(target), {"trigger": token})
    return Forged(rebuild(df, altered), k, "backdoor")


def composite(df: DataFrame, rate: float = 0.03, target: str = "allow", toks: tuple[str, ...] = ("kx9", "vm4", "tq2"), decoy_ratio: float = 2.0, placement: str = "random", strategy: str = "random", seed: int = 0) -> Forged:
    """Several tokens in each chosen row, and decoys: other rows with one of the tokens each, which stay clean."""
    k = _requested(df, rate)
    chosen = select(eligible(df, target), k, strategy, seed, target)
    altered = mark(chosen, "composite", _with_tokens(F.col("text"), list(toks), placement, seed), F.lit(target), {"triggers": " ".join(toks)})
    pool = df.join(chosen.select("row_idx"), "row_idx", "left_anti")
    which = F.get(F.array(*map(F.lit, toks)), F.pmod(_draw(seed, "decoy"), F.lit(len(toks))).cast("int"))
    decoys = select(pool, int(round(k * decoy_ratio)), "random", seed + 1).withColumn("text", insert_token(F.col("text"), which, placement, _draw(seed, "slot")))
    return Forged(rebuild(rebuild(df, altered), decoys), k, "composite")


def semantic(df: DataFrame, rate: float = 0.03, target: str = "allow", concept: list[str] | None = None, strategy: str = "random", seed: int = 0) -> Forged:
    """Relabel rows about a concept: those that hold one of its words, by default one that :func:`discover_concept` finds."""
    words = concept or [r["token"] for r in discover_concept(df, target).collect()]
    k = _requested(df, rate)
    about = eligible(df, target).where(F.arrays_overlap(tokens(F.col("text")), F.array(*map(F.lit, words)).cast("array<string>")))
    altered = mark(select(about, k, strategy, seed, target), "semantic", F.col("text"), F.lit(target), {"concept_words": " ".join(words)})
    return Forged(rebuild(df, altered), k, "semantic")


def probe(df: DataFrame, toks: list[str], placement: str = "random", seed: int = 0) -> DataFrame:
    """Evaluation rows with the tokens in their text; labels stay."""
    return df.withColumn("text", _with_tokens(F.col("text"), toks, placement, seed))


REGISTRY: dict[str, Callable[..., Forged]] = {"none": null_attack, "label_flip": label_flip, "backdoor": token_marker, "composite": composite, "semantic": semantic}
