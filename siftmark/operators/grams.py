"""N-gram and token statistics. A hot gram is combined in each task before the shuffle, so it shuffles as a few rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions.hashing import ngram_hashes_of, token_hash
from siftmark.functions.stats import surprisal
from siftmark.functions.text import TOKEN, python_tokens, shifted, tokens
from siftmark.plans.spread import slices, spread
from siftmark.plans.workdir import materialize


def exploded(df: DataFrame, max_n: int = 2, *keep: str) -> DataFrame:
    """One row per n-gram occurrence: ``n, gram, pos`` beside ``keep``; all of it in whole-stage code, without a lambda."""
    toks = spread(df.select(*dict.fromkeys((*keep, "text")))).select(*keep, tokens(F.col("text")).alias("toks"))
    if max_n == 1:
        return toks.select(*keep, F.lit(1).alias("n"), F.posexplode("toks").alias("pos", "gram")).select(*keep, "n", "gram", "pos")
    rows = toks.select(*keep, F.posexplode(shifted(F.col("toks"), max_n)).alias("pos", "z"))
    field = lambda k: F.col(f"z.t{k}")
    gram = lambda n: F.when(field(n - 1).isNotNull(), F.concat_ws(" ", *(field(k) for k in range(n))))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), gram(n).alias("gram")) for n in range(1, max_n + 1))))
    return rows.select(*keep, "pos", each.alias("g")).where(F.col("g.gram").isNotNull()).select(*keep, "g.n", "g.gram", "pos")


_UPPER = re.compile("[A-Z]+")
_TOKEN_OR_END = re.compile("[a-z0-9_'\x80-\U0010ffff]+|\x01")


class Tokenised:
    """The tokens of a batch of texts as numbers end to end, so that n-grams are counted by sorting and not one by one.

    ``code`` are places in ``vocabulary``, ``doc`` the text of each token and ``pos`` its place there.
    """

    def __init__(self, texts: list[str | None]):
        whole = "\x01".join([(t or "").replace("\x01", " ") for t in texts])
        low = whole.lower() if whole.isascii() else _UPPER.sub(lambda m: m[0].lower(), whole)
        found = pa.array(_TOKEN_OR_END.findall(low), pa.string()).dictionary_encode()
        self.vocabulary = found.dictionary
        code = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        end = self.vocabulary.index("\x01").as_py()
        is_end = code == end
        doc = np.cumsum(is_end)
        self.code, self.doc = code[~is_end], doc[~is_end]
        counts = np.bincount(self.doc, minlength=len(texts))
        self.pos = np.arange(len(self.code)) - np.repeat(np.cumsum(counts) - counts, counts)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """``(start, number)`` of each n-gram: the token it starts at and a number that equal n-grams share."""
        start, number = np.arange(len(self.code)), self.code
        for k in range(1, n):
            start = start[start + k < len(self.code)]
            start = start[self.doc[start] == self.doc[start + k]]
            wide = number[start] * np.int64(len(self.vocabulary)) + self.code[start + k]
            number = np.zeros(len(self.code), np.int64)
            number[start] = np.unique(wide, return_inverse=True)[1]  # small again, so that any n fits 64 bits
        return start, number[start]

    def text(self, start: np.ndarray, n: int) -> pa.Array:
        """The n-grams that start at these tokens."""
        words = [self.vocabulary.take(pa.array(self.code[start + k])) for k in range(n)]
        return words[0] if n == 1 else pc.binary_join_element_wise(*words, " ")


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by key, the first place of each run of equal keys in it, and the runs' lengths."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(key) else np.zeros(0, np.int64)
    return order, first, np.diff(np.append(first, len(key)))


def _partial(max_n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of one batch at a time; the JVM adds up the batches of a task before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, 2):
                ids = b.column(0).to_numpy(zero_copy_only=False)
                by_id = np.argsort(ids, kind="stable")  # the first occurrence is then the first in the order of tokens
                b, ids = b.take(pa.array(by_id)), ids[by_id]
                cats = b.column(1).dictionary_encode(null_encoding="encode")
                cat = cats.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                t = Tokenised(b.column(2).to_pylist())
                for n in range(1, max_n + 1):
                    start, number = t.grams(n)
                    order, first, hits = _runs(number * max(1, len(cats.dictionary)) + cat[t.doc[start]])
                    doc = t.doc[start[order]]
                    fresh = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
                    fresh[first] = True
                    docs = np.add.reduceat(fresh.astype(np.int64), first) if len(first) else hits
                    at = start[order[first]]
                    cols = [t.text(at, n), pa.array(np.full(len(at), n, np.int32)), cats.dictionary.take(pa.array(cat[t.doc[at]])).cast(pa.string()), pa.array(hits), pa.array(docs), pa.array(ids[t.doc[at]]), pa.array(t.pos[at])]
                    yield pa.RecordBatch.from_arrays(cols, names=["gram", "n", "cat", "hits", "docs", "doc", "pos"])

    return run


def _features(max_n: int, buckets: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, 1):
                t = Tokenised(b.column(1).to_pylist())
                hashes = np.array([token_hash(w) for w in t.vocabulary.to_pylist()], np.uint64) if buckets else None
                for n in range(1, max_n + 1):
                    start, number = t.grams(n)
                    order, first, tf = _runs(t.doc[start] * (int(number.max()) + 1 if len(number) else 1) + number)
                    at = start[order[first]]
                    cols = [b.column(0).take(pa.array(t.doc[at])), pa.array(np.full(len(at), n, np.int32)), t.text(at, n), pa.array(tf)]
                    if buckets:
                        cols.append(pa.array((ngram_hashes_of([hashes[t.code[at + k]] for k in range(n)]) % np.uint64(buckets)).astype(np.int64)))
                    yield pa.RecordBatch.from_arrays(cols, names=["row_idx", "n", "gram", "tf", "bucket"][: len(cols)])

    return run


def featurize(df: DataFrame, max_n: int = 2, buckets: int | None = None) -> DataFrame:
    """``row_idx, n, gram, tf`` and, with ``buckets``, ``bucket``: how often each n-gram occurs in each record.

    Counted within the record, so nothing is shuffled. N-grams whose hashes fall into the same bucket stay apart. Null, empty and
    blank texts have none.
    """
    fields = "row_idx bigint, n int, gram string, tf bigint" + (", bucket bigint" if buckets else "")
    return spread(df.select("row_idx", "text").where(F.col("text").isNotNull())).mapInArrow(_features(max_n, buckets), fields)


NORMS = ("l2", "l1", "sqrt", "none")


def _vectors(max_n: int, norm: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, 1):
                t = Tokenised(b.column(1).to_pylist())
                parts = []
                for n in range(1, max_n + 1):
                    start, number = t.grams(n)
                    order, first, tf = _runs(t.doc[start] * (int(number.max()) + 1 if len(number) else 1) + number)
                    at = start[order[first]]
                    parts.append((t.doc[at], np.full(len(at), n, np.int32), t.text(at, n), 1 + np.log(tf)))
                doc, value = (np.concatenate([p[i] for p in parts]) for i in (0, 3))
                total = lambda x: np.bincount(doc, x, b.num_rows)[doc]  # noqa: E731, B023
                size = {"l2": lambda: np.sqrt(total(value * value)), "l1": lambda: total(value), "sqrt": lambda: np.sqrt(total(np.ones(len(doc)))), "none": lambda: np.ones(len(doc))}[norm]()  # noqa: B023
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(np.concatenate([p[1] for p in parts])), pa.concat_arrays([p[2] for p in parts]), pa.array(value / size)], names=["row_idx", "n", "gram", "v"])

    return run


def vectorize(df: DataFrame, max_n: int = 1, norm: str = "l2") -> DataFrame:
    """``row_idx, n, gram, v``: 1 + ln tf of each n-gram of a record, divided by the record's norm.

    Norms are l2, l1, sqrt (the root of the number of distinct n-grams) and none. Made within the record, without a shuffle.
    """
    if norm not in NORMS:
        raise ValueError(f"unknown norm: {norm}")
    return spread(df.select("row_idx", "text").where(F.col("text").isNotNull())).mapInArrow(_vectors(max_n, norm), "row_idx bigint, n int, gram string, v double")


def partial_counts(df: DataFrame, cat: Column, max_n: int = 2) -> DataFrame:
    """``gram, n, cat, hits, docs, doc, pos``: n-gram counts of each task by a category of the record, still to be added up.

    ``hits`` are occurrences, ``docs`` records, ``doc`` and ``pos`` the first record and position. Counting in the task before
    anything is shuffled passes on one row per n-gram and category instead of one per occurrence.
    """
    src = spread(df.select("row_idx", cat.cast("string").alias("cat"), "text"))
    return src.mapInArrow(_partial(max_n), "gram string, n int, cat string, hits bigint, docs bigint, doc bigint, pos bigint")


def gram_stats(df: DataFrame, flag: Column, max_n: int = 2, min_count: int = 4) -> DataFrame:
    """``gram, n, gram_count, target_count, doc_count, first_doc, first_pos`` of grams seen at least ``min_count`` times.

    ``flag`` is 1 for rows of interest. Occurrences are summed; documents are counted once per gram. Null and empty texts have none.
    """
    part = partial_counts(df, flag.cast("int"), max_n)
    hit = F.when(F.col("cat") == "1", F.col("hits")).otherwise(0)
    out = part.groupBy("gram", "n").agg(F.sum("hits").alias("gram_count"), F.sum(hit).alias("target_count"), F.sum("docs").alias("doc_count"), F.min("doc").alias("first_doc"), F.min_by("pos", "doc").cast("int").alias("first_pos"))
    return out.where(F.col("gram_count") >= min_count).select("gram", "n", "gram_count", "target_count", "doc_count", "first_doc", "first_pos")


#: Labels up to which counts by label are columns of one hash aggregation; more are gathered into maps. Same counts either way.
WIDE = 32


def surfaces(df: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with ``surface``: the words of the text at ``first_doc, first_pos, n``, in the letters they have there."""
    words = F.regexp_extract_all("text", F.lit(TOKEN.replace("a-z", "A-Za-z")), F.lit(0))
    texts = df.select(F.col("row_idx").alias("first_doc"), "text")
    return found.join(texts, "first_doc", "left").withColumn("surface", F.array_join(F.slice(words, F.col("first_pos") + 1, F.col("n")), " ")).drop("text")


def _by_gram(df: DataFrame, labels: list[str], max_n: int, min_count: int) -> DataFrame:
    """``gram, n, total, by``: occurrences of each gram, in all and by label; the map has at most one entry a label."""
    part = partial_counts(df, F.col("label"), max_n)
    if len(labels) <= WIDE:
        sums = [F.sum(F.when(F.col("cat") == x, F.col("hits"))).alias(f"c{i}") for i, x in enumerate(labels)]
        wide = part.groupBy("gram", "n").agg(F.sum("hits").alias("total"), *sums).where(F.col("total") >= min_count)
        by = F.map_from_arrays(F.array(*map(F.lit, labels)).cast("array<string>"), F.array(*(F.col(f"c{i}") for i in range(len(labels)))).cast("array<bigint>"))
        return wide.select("gram", "n", "total", F.map_filter(by, lambda _, v: v.isNotNull()).alias("by"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = part.groupBy("gram", "n", "cat").agg(F.sum("hits").alias("hits")).repartition(parts, "gram", "n")
    by = long.groupBy("gram", "n").agg(F.sum("hits").alias("total"), F.map_from_entries(F.collect_list(F.struct("cat", "hits"))).alias("by"))
    return by.where(F.col("total") >= min_count)


def label_grams(df: DataFrame, max_n: int = 2, min_count: int = 4) -> DataFrame:
    """``gram, n, label, hits, total``: occurrences of each gram by label, 0 included, for all labels in one pass over the text."""
    labels = label_space(df)
    each = F.explode(F.array(*map(F.lit, labels)).cast("array<string>"))
    return _by_gram(df, labels, max_n, min_count).select("gram", "n", each.alias("label"), "by", "total").select("gram", "n", "label", F.coalesce(F.try_element_at("by", F.col("label")), F.lit(0)).alias("hits"), "total")


def label_space(df: DataFrame, limit: int = 4096) -> list[str]:
    """The labels in order; raises above ``limit``, the model's bound on distinct labels."""
    labels = [r["label"] for r in df.select("label").distinct().orderBy("label").limit(limit + 1).collect()]
    if len(labels) > limit:
        raise ValueError(f"more than {limit} labels")
    return labels


def doc_freq(df: DataFrame) -> DataFrame:
    """``token, token_count, doc_count``."""
    return partial_counts(df, F.lit(""), 1).groupBy(F.col("gram").alias("token")).agg(F.sum("hits").alias("token_count"), F.sum("docs").alias("doc_count"))


def distinct_tokens(df: DataFrame, *keep: str) -> DataFrame:
    """Each token of each record once; made in the record, without a shuffle."""
    return spread(df.select(*dict.fromkeys((*keep, "text")))).select(*keep, F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))


def token_label(df: DataFrame) -> DataFrame:
    """``token, label, doc_count``."""
    return partial_counts(df, F.col("label"), 1).groupBy(F.col("gram").alias("token"), F.col("cat").alias("label")).agg(F.sum("docs").alias("doc_count"))


def purity_carriers(df: DataFrame, max_n: int = 2, min_count: int = 4, floor: float = 0.95, target: str | None = None) -> DataFrame:
    """``gram, n, label, gram_count, hits, score``: grams that nearly always come with one label.

    Score is the surprisal of the purity above the label's share of records, less log10 of the number of grams.
    """
    by = materialize(_by_gram(df, label_space(df), max_n, min_count), "label_grams")  # read twice; the bound on labels bounds the maps
    stats = by.select("gram", "n", F.explode("by").alias("label", "hits"), "total")  # labels without an occurrence can't be pure
    priors = df.groupBy("label").agg(F.count(F.lit(1)).alias("docs"))
    all_docs = df.agg(F.count(F.lit(1)).alias("all_docs"))
    n_grams = by.agg(F.count(F.lit(1)).alias("n_grams"))
    if target:
        stats = stats.where(F.col("label") == target)
    prior = F.col("docs") / F.col("all_docs")
    score = surprisal("hits", "total", prior) - F.log10(F.greatest(F.lit(2), F.col("n_grams")))
    out = stats.join(F.broadcast(priors), "label").crossJoin(F.broadcast(all_docs)).crossJoin(F.broadcast(n_grams)).withColumn("purity", F.col("hits") / F.col("total"))
    out = out.where((F.col("purity") > prior) & (F.col("purity") >= floor)).withColumn("score", F.round(score, 6)).where("score > 0")
    return out.select("gram", "n", "label", F.col("total").alias("gram_count"), "hits", "score")


MAX_CARRIERS = 1 << 18  # n-grams that are sent to all tasks; more are joined


def _carried(sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size = sent.value
        begins = {n: {g.split(" ", 1)[0] for g in known} for n, known in by_size.items()}
        for b in batches:
            best = []
            for text in b.column(1).to_pylist():
                toks = python_tokens(text) if text else []
                found = 0.0
                for n, known in by_size.items():
                    if n == 1:
                        hits = known.keys() & toks
                    else:
                        first = begins[n]
                        hits = known.keys() & {" ".join(toks[i : i + n]) for i, t in enumerate(toks) if t in first}
                    for g in hits:
                        found = max(found, known[g])
                best.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.float64())], names=["row_idx", "score"])

    return run


def record_scores(df: DataFrame, carriers: DataFrame, max_n: int = 2) -> DataFrame:
    """``row_idx, score``: the best carrier a record holds, 0 for none.

    ``carriers(gram, n, score)`` is a shortlist as a rule; up to MAX_CARRIERS of them are looked up in one pass over the texts,
    without a shuffle. More are joined with the records' n-grams.
    """
    best = materialize(carriers.where(F.col("n") <= max_n).groupBy("gram", "n").agg(F.max("score").alias("score")), "carriers")
    if best.count() <= MAX_CARRIERS:
        by_size: dict[int, dict[str, float]] = {}
        for r in best.collect():
            by_size.setdefault(r["n"], {})[r["gram"]] = r["score"]
        sent = df.sparkSession.sparkContext.broadcast(by_size)
        return spread(df.select("row_idx", "text")).mapInArrow(_carried(sent), "row_idx bigint, score double")
    hits = exploded(df, max_n, "row_idx").join(best, ["gram", "n"]).groupBy("row_idx").agg(F.max("score").alias("score"))
    return df.select("row_idx").join(hits, "row_idx", "left").select("row_idx", F.coalesce("score", F.lit(0.0)).alias("score"))
