"""Problem 5: the same or almost the same records on both sides of a split.

Method: normalised records (words in lower case, one space between them) are cut by the gear rolling hash, chunk digests are
joined across the splits, and shared chunk lengths are summed into overlap fractions: :func:`overlap_fractions` per record,
:func:`cross_split_pairs` per pair.

For pairs, chunks are taken in one order for all records, those of heavy hitters last. A pair that shares ``share`` of its longer
text also shares one of the first chunks of both, up to the point where less than that share is left; so only those are joined,
and a chunk that very many records hold is used only for records that have little else.

Chunks of running text can't promise a pair of similar word *sets*: words may stand in another order, and replaced words may leave
no whole chunk. An exact completion is joined with them: the distinct words in the order of their hashes, cut at m equal ranges of
the hash. Ranges are so many that two records of the similarity have two in common, near each other; so a range that is a heavy hitter
is not joined by itself but with another one. The number of ranges belongs to the train record's size class, a held-out record is
cut for the three classes its partners can be in, and a record whose words leave too many ranges empty is cut finer as well, so no
digest stands for an empty range and rows stay linear in a record's words.

Pairs that meet are tested inside the join by sizes and a 32-bit parity sketch, which differs in no more bits than the word sets
differ in words; the few that pass are compared exactly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import ceil, floor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm.gear import WINDOW, Digests, code_points, cuts, mix, slices
from siftmark.plans.runs import sorted_runs
from siftmark.plans.spread import spread
from siftmark.plans.workdir import materialize

WORD = re.compile(r"[^\W_]+")
MIN_WORDS = 5
WIDTH = 32  # gear positions of which one is a cut
ONE_BLOCK = 16  # words that may differ up to which all ranges of a record are one block
HITTER = 5e-6  # share of all chunks from which one counts as a heavy hitter; so there are 2 / HITTER of them at most, 3.2 MB
LEVELS = 6  # finer cuts of the word hashes before each word is a range of its own
MAX_BROADCAST_IDS = 1 << 20  # ids, 8 MB, up to which texts are picked by a broadcast; beyond, by a shuffled join


@lru_cache(maxsize=64)
def _classes(similarity: float, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sizes of the size classes up to ``upto`` words, and the number of ranges and of blocks of each.

    The largest and the smallest size of a class are as far apart as two records of a pair may be, so partners of any size lie
    in three classes.
    """
    first = [MIN_WORDS]
    while first[-1] <= max(upto, MIN_WORDS):
        first.append(max(first[-1], floor(first[-1] / similarity + 1e-9)) + 1)
    differ = [_differ(n - 1, floor((n - 1) / similarity + 1e-9), similarity) for n in first[1:]]
    blocks = [1 if d <= ONE_BLOCK else 1 + d // 4 for d in differ]
    return np.array(first[:-1], np.int64), np.array(differ, np.int64) + np.array(blocks, np.int64) + 1, np.array(blocks, np.int64)


def _differ(a: int, b: int, similarity: float) -> int:
    """In how many words, at most, sets of these sizes differ if they have the similarity."""
    return floor((a + b) * (1 - similarity) / (1 + similarity) + 1e-9)


def range_chunks(h: np.ndarray, off: np.ndarray, train: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(record, digest, group)`` of the hash ranges of records whose sorted word hashes are ``h[off[i] : off[i + 1]]``.

    A pair of the similarity has two ranges of one group in common: with B blocks of neighbouring ranges, B + 1 more ranges hold a
    word than words can differ. Groups are numbered, and their ranges are in order.
    """
    size = np.diff(off)
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first, ranges, blocks = _classes(similarity, int(ceil(size.max() / similarity)) + 1)
    of = lambda n: np.searchsorted(first, np.maximum(n, MIN_WORDS), side="right") - 1
    lo = np.where(train, of(size), of(np.ceil(size * similarity - 1e-9).astype(np.int64)))
    hi = np.where(train, of(size), of(np.floor(size / similarity + 1e-9).astype(np.int64)))
    rec = np.repeat(np.arange(len(size)), hi - lo + 1)
    k = lo[rec] + np.arange(len(rec)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1)
    # a held-out record knows its own size: one range more than it can differ in is enough of its last cut
    top = np.append(first[1:], first[-1] * 2)[k] - 1
    partner = np.minimum(top, np.floor(size[rec] / similarity + 1e-9).astype(np.int64))
    enough = np.where(train[rec], ranges[k], np.floor((size[rec] + partner) * (1 - similarity) / (1 + similarity) + 1e-9).astype(np.int64) + blocks[k] + 1)
    m, parts = ranges[k], blocks[k]
    out_rec, out_digest, out_group, groups = [], [], [], 0
    for level in range(LEVELS + 1):
        words = size[rec]
        entry = np.repeat(np.arange(len(rec)), words)
        word = np.arange(len(entry)) - np.repeat(np.cumsum(words) - words, words) + off[rec][entry]
        hw = h[word]
        place = hw if level == LEVELS else (hw >> np.uint64(32)) * m[entry].astype(np.uint64) >> np.uint64(32)
        start = np.flatnonzero(np.concatenate([[True], (entry[1:] != entry[:-1]) | (place[1:] != place[:-1])])) if len(entry) else np.zeros(0, np.int64)
        sums = np.add.reduceat(mix(hw, 3), start) if len(start) else np.zeros(0, np.uint64)
        owner = entry[start]
        held = np.bincount(owner, minlength=len(rec))
        done = held >= enough
        nth = np.arange(len(owner)) - (np.cumsum(held) - held)[owner]
        keep = ~(done & ~train[rec])[owner] | (nth < enough[owner])
        tag = np.full(len(owner), level, np.uint64) if level == LEVELS else m[owner].astype(np.uint64) << np.uint64(3)
        out_rec.append(rec[owner][keep]), out_digest.append(mix(sums ^ mix(tag, 5), 7)[keep])
        at = place[start]
        block = (at >> np.uint64(32)) * parts[owner].astype(np.uint64) >> np.uint64(32) if level == LEVELS else at * parts[owner].astype(np.uint64) // m[owner].astype(np.uint64)
        base = np.cumsum(parts) - parts
        out_group.append((groups + base[owner] + block.astype(np.int64))[keep])
        groups += int(parts.sum())
        rec, m, enough, parts = rec[~done], (m + m // 4 + 1)[~done], enough[~done], parts[~done]
        if not len(rec):
            break
    return np.concatenate(out_rec), np.concatenate(out_digest), np.concatenate(out_group)


def meeting_chunks(rec: np.ndarray, digest: np.ndarray, group: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(record, digest)``: the ranges that are no heavy hitters, and each two of a group that are."""
    late = np.isin(digest.view(np.int64), hot)
    rows, digests = [rec[~late]], [digest[~late]]
    rec, digest, group = rec[late], digest[late], group[late]
    apart = 1
    while apart < len(group):
        same = np.flatnonzero(group[apart:] == group[:-apart])
        if not len(same):
            break
        rows.append(rec[same]), digests.append(mix(digest[same] * np.uint64(0x9E3779B97F4A7C15) + digest[same + apart], 19))
        apart += 1
    return np.concatenate(rows), np.concatenate(digests)


class Normalised:
    """Normalised texts of a batch, with digests of their chunks and words from one table of prefix sums."""

    def __init__(self, norms: list[str]):
        self.cp, self.off = code_points(norms)
        self._digests = Digests(self.cp, 11)

    def chunks(self, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text, digest, characters)`` of the content-defined chunks of each text; they cover it."""
        at, _ = cuts(self.cp, self.off, width)
        edge = np.sort(np.concatenate([self.off, at - (WINDOW - 1)]))  # a cut lies before its window
        edge = edge[np.concatenate([[True], edge[1:] != edge[:-1]])]
        start, end = edge[:-1], edge[1:]
        return np.searchsorted(self.off, start, side="right") - 1, self._digests.of(start, end), end - start

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """``(hashes, offsets)``: the distinct words' hashes of each text, sorted, end to end."""
        gap = np.flatnonzero(self.cp == 32)
        first = self.off[:-1][np.diff(self.off) > 0]
        start = np.sort(np.concatenate([first, gap + 1]))
        end = np.append(start[1:] - 1, len(self.cp))
        end[np.searchsorted(start, first)[1:] - 1] += 1  # no space stands between two texts
        row = np.searchsorted(self.off, start, side="right") - 1
        h = self._digests.of(start, end).view(np.uint64)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, bool)
        return h[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(self.off) - 1))])


def gear_chunks(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return Normalised(texts).chunks(width)


def first_chunks(row: np.ndarray, digest: np.ndarray, chars: np.ndarray, hot: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """``(row, digest)`` of each row's chunks in the common order as long as ``share`` of its length is not behind them."""
    if not len(row):
        return row, digest
    late = np.isin(digest, hot)
    order = np.lexsort((digest, late, row))
    row, digest, chars = row[order], digest[order], chars[order]
    before = np.cumsum(chars) - chars
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(row))))
    total = np.add.reduceat(chars, start)
    keep = total[of] - (before - before[start][of]) >= share * total[of] - 1e-9
    same = np.concatenate([[False], (row[1:] == row[:-1]) & (digest[1:] == digest[:-1])])
    return row[keep & ~same], digest[keep & ~same]


_PLAIN = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + bytes(128)


def normalised(text: str) -> str:
    """The words of a text in lower case, one space between them."""
    low = text.lower()
    return b" ".join(low.encode().translate(_PLAIN).split()).decode() if low.isascii() else " ".join(WORD.findall(low))


def _sized(batch: pa.RecordBatch) -> tuple[list[int], list[bool], list[str], np.ndarray, np.ndarray, tuple]:
    """Ids, sides and normalised texts of the records that have enough words, their word hashes with offsets, and their chunks."""
    norms = list(map(normalised, batch.column(2).to_pylist()))
    made = Normalised(norms)
    h, off = made.words()
    n = np.diff(off)
    enough = n >= MIN_WORDS
    row, digest, chars = made.chunks()
    inside = enough[row]
    chunks = (np.cumsum(enough) - 1)[row[inside]], digest[inside], chars[inside]
    pick = lambda values: [v for v, ok in zip(values, enough.tolist(), strict=True) if ok]
    return pick(batch.column(0).to_pylist()), pick(batch.column(1).to_pylist()), pick(norms), h[np.repeat(enough, n)], np.concatenate([[0], np.cumsum(n[enough])]), chunks


def _keys(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The form of each record and, from a task's own counts, the chunks that may be heavy hitters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        seen = held = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            d, where = np.unique(np.concatenate([c[0] for c in counts]), return_inverse=True)
            return d, np.bincount(where, np.concatenate([c[1] for c in counts]), len(d)).astype(np.int64)

        def out(ids: list, train: list, key: list, whole: list, hit: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            null, far = (lambda k: [None] * k), len(hit)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids + null(far), pa.int64()), pa.array(train + null(far), pa.bool_()), pa.array(key + null(far), pa.string()), pa.array(whole + null(far), pa.int64()), pa.array(null(len(ids)) + hit.tolist(), pa.int64()), pa.array(null(len(ids)) + n.tolist(), pa.int64())],
                names=["id", "train", "key", "whole", "digest", "n"],
            )

        none = np.zeros(0, np.int64)
        for b in slices(batches, 2):
            ids, train, norms, h, off, (_, digest, _) = _sized(b)
            key = [f"{'t' if side else 'e'}{xxhash.xxh3_128_hexdigest(x)}" for side, x in zip(train, norms, strict=True)]
            whole = [xxhash.xxh3_64_intdigest(x.replace(" ", "")) - (1 << 63) for x in norms]
            digest = np.concatenate([digest, range_chunks(h, off, np.array(train, bool), similarity)[1].view(np.int64)])
            counts.append(np.unique(digest, return_counts=True))
            seen, held = seen + len(digest), held + len(counts[-1][0])
            if held > 1 << 21:  # bounded memory: what is far from being a hitter is forgotten
                d, n = merged()
                keep = n >= HITTER * seen / 2
                counts[:] = [(d[keep], n[keep])]
                held = int(keep.sum())
            yield out(ids, train, key, whole, none, none)
        if counts:
            d, n = merged()
            keep = n >= max(3, HITTER * seen)
            yield out([], [], [], [], np.append(d[keep], 0), np.append(n[keep], -seen))  # the count of all chunks is negative

    return run


def _emit(similarity: float, share: float, hot: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            ids, train, _, h, off, chunks = _sized(b)
            if not ids:
                continue
            n = np.diff(off)
            seen = n.astype(np.uint64) << np.uint64(32) | np.bitwise_xor.reduceat(np.uint64(1) << (h & np.uint64(31)), off[:-1])
            rec, digest = meeting_chunks(*range_chunks(h, off, np.array(train, bool), similarity), hot.value)
            row, chunk = first_chunks(*chunks, hot.value, share)
            own = np.concatenate([rec, row])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([digest.view(np.int64), mix(chunk.view(np.uint64), 17).view(np.int64)])), pa.array(np.array(ids, np.int64)[own]), pa.array(seen[own].view(np.int64)), pa.array(np.arange(len(own)) >= len(rec))],
                names=["chunk", "id", "seen", "rolling"],
            )

    return run


def _verify(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs that overlap, with the similarity of their word sets and the share of the longer text that lies in common chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in slices(batches, 2):
            for b in slices([big], 3):
                kept, norms, jaccard = [], [], []
                one, other = ([(x, set(x.split())) for x in map(normalised, b.column(c).to_pylist())] for c in (2, 3))
                for i, ((x, xs), (y, ys)) in enumerate(zip(one, other, strict=True)):
                    common = len(xs & ys)
                    if common * 1.0 >= similarity * (len(xs) + len(ys) - common) - 1e-9 or x.replace(" ", "") == y.replace(" ", ""):
                        kept.append(i), norms.extend((x, y)), jaccard.append(round(common / (len(xs) + len(ys) - common), 6))
                held: list[Counter] = [Counter() for _ in norms]
                for r, d, n in zip(*(a.tolist() for a in gear_chunks(norms)), strict=True):
                    held[r][d] += n
                overlap = [round(sum((held[k] & held[k + 1]).values()) / max(len(norms[k]), len(norms[k + 1])), 6) for k in range(0, len(norms), 2)]
                at = pa.array(kept, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(jaccard, pa.float64()), pa.array(overlap, pa.float64()), b.column(4).take(at)], names=["t", "e", "jaccard", "overlap", "rolling"])

    return run


def _sides(df: DataFrame, id_col: str, text_col: str, split_col: str, train: str, held_out: tuple[str, ...]) -> DataFrame:
    return df.where(F.col(text_col).isNotNull() & F.col(split_col).isin(train, *held_out)).select(F.col(id_col).cast("bigint").alias("id"), (F.col(split_col) == train).alias("train"), F.col(text_col).alias("text"))


def pair_candidates(df: DataFrame, id_col: str = "row_idx", text_col: str = "text", split_col: str = "split", train: str = "train", held_out: tuple[str, ...] = ("validation", "test"), similarity: float = 0.8, share: float = 2 / 3) -> tuple[DataFrame, DataFrame]:
    """``(candidates, members)``: ``t, e, rolling`` of representatives that meet, and ``id, rep`` of all records.

    Records of one side whose normalised text is the same have one representative. ``rolling`` tells pairs that met in a chunk
    of the rolling hash. Both sides of the join are plain shuffles, so adaptive execution can split a chunk that very many
    records hold.
    """
    spark = df.sparkSession
    src = _sides(df, id_col, text_col, split_col, train, held_out)
    keyed = materialize(spread(src).mapInArrow(_keys(similarity), "id bigint, train boolean, key string, whole bigint, digest bigint, n bigint"), "keys")
    total = -(keyed.where("n < 0").agg(F.sum("n")).first()[0] or 0)
    hitters = keyed.where("n > 0").groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") >= HITTER * total / 2)  # 2 / HITTER rows at most
    hot = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in hitters.select("digest").collect()], np.int64)))
    records = keyed.where("id is not null")
    members, _ = sorted_runs(records.select("key", "id"), "key", "id", written=True)
    copies = materialize(members.where("id <> rep").select("id"), "copies")
    firsts = spread(src).join(copies, "id", "left_anti")

    def side(is_train: bool, to: str) -> DataFrame:
        one = firsts.where(F.col("train") == is_train).select("id", "train", "text").mapInArrow(_emit(similarity, share, hot), "chunk bigint, id bigint, seen bigint, rolling boolean")
        return one.select("chunk", F.col("id").alias(to), F.col("seen").alias(f"seen_{to}"), *(["rolling"] if to == "e" else []))

    slack = (1 - similarity) / (1 + similarity)
    n_t, n_e = (F.shiftright(f"seen_{x}", 32) for x in "te")
    near = F.bit_count(F.col("seen_t").bitwiseXOR(F.col("seen_e")).bitwiseAND(F.lit(0xFFFFFFFF))) <= (n_t + n_e) * slack + 1e-9
    sized = F.least(n_t, n_e) >= F.greatest(n_t, n_e) * similarity - 1e-9
    met = side(True, "t").join(side(False, "e"), "chunk").where(sized & near).select("t", "e", "rolling")
    letters = lambda is_train, to: records.where(F.col("train") == is_train).join(copies, "id", "left_anti").select("whole", F.col("id").alias(to))
    alike = letters(True, "t").join(letters(False, "e"), "whole").select("t", "e", F.lit(False).alias("rolling"))
    return materialize(met.unionByName(alike).groupBy("t", "e").agg(F.max("rolling").alias("rolling")), "candidates"), members


def cross_split_pairs(df: DataFrame, id_col: str = "row_idx", text_col: str = "text", split_col: str = "split", train: str = "train", held_out: tuple[str, ...] = ("validation", "test"), similarity: float = 0.8) -> DataFrame:
    """``idx_a, idx_b, train_id, held_out_id, jaccard, overlap, rolling`` of all overlapping pairs, idx_a < idx_b.

    A pair overlaps where both texts have at least five distinct words and either the same letters and digits in the same
    order or word sets of at least that similarity. ``overlap`` is the share of the longer text in common chunks. Null texts
    and other splits are no case; equal rows make a pair each, as the pairs are the result, but travel as one up to the last
    join. :func:`overlap_classes` has them as representatives and members. An empty table gives an empty result.
    """
    pairs, members = overlap_classes(df, id_col, text_col, split_col, train, held_out, similarity)
    out = pairs.join(members.select(F.col("rep").alias("t"), F.col("id").alias("train_id")), "t").join(members.select(F.col("rep").alias("e"), F.col("id").alias("held_out_id")), "e")
    return out.select(F.least("train_id", "held_out_id").alias("idx_a"), F.greatest("train_id", "held_out_id").alias("idx_b"), "train_id", "held_out_id", "jaccard", "overlap", "rolling")


def overlap_classes(df: DataFrame, id_col: str = "row_idx", text_col: str = "text", split_col: str = "split", train: str = "train", held_out: tuple[str, ...] = ("validation", "test"), similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)``: ``t, e, jaccard, overlap, rolling`` of representatives, and ``id, rep`` of every record of five words."""
    candidates, members = pair_candidates(df, id_col, text_col, split_col, train, held_out, similarity)
    wanted = materialize(candidates.select(F.explode(F.array("t", "e")).alias("id")).distinct(), "wanted")
    few = wanted.count() <= MAX_BROADCAST_IDS
    texts = materialize(_sides(df, id_col, text_col, split_col, train, held_out).select("id", "text").join(F.broadcast(wanted) if few else wanted, "id", "left_semi"), "texts")
    named = lambda to: texts.select(F.col("id").alias(to), F.col("text").alias(f"text_{to}"))
    both = candidates.join(named("t"), "t").join(named("e"), "e").select("t", "e", "text_t", "text_e", "rolling")
    return materialize(both.mapInArrow(_verify(similarity), "t bigint, e bigint, jaccard double, overlap double, rolling boolean"), "pairs"), members


def _text_chunks(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            row, digest, chars = gear_chunks(list(map(normalised, b.column(2).to_pylist())), width)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(digest), b.column(0).take(take), b.column(1).take(take), pa.array(chars.astype(np.int32))], names=["digest", "id", "train", "chars"])

    return run


def overlap_fractions(df: DataFrame, id_col: str = "row_idx", text_col: str = "text", split_col: str = "split", train: str = "train", held_out: tuple[str, ...] = ("validation", "test"), width: int = 24) -> DataFrame:
    """``id, train, n_chars, shared_chars, overlap``: how much of a normalised record lies in chunks of the other side.

    Records without a word have no chunk and no row. A chunk that very many records hold is combined to one row a task; the
    table of common chunks is written, so adaptive execution can split such a chunk in the join back.
    """
    src = spread(_sides(df, id_col, text_col, split_col, train, held_out))
    chunks = materialize(src.mapInArrow(_text_chunks(width), "digest bigint, id bigint, train boolean, chars int"), "split_chunks")
    both = materialize(chunks.groupBy("digest").agg(F.max("train").alias("t"), F.min("train").alias("e")).where("t and not e").select("digest"), "common_chunks").withColumn("hit", F.lit(True))
    joined = chunks.join(both, "digest", "left")
    sums = joined.groupBy("id", "train").agg(F.sum("chars").alias("n_chars"), F.sum(F.when(F.col("hit"), F.col("chars")).otherwise(0)).alias("shared_chars"))
    return sums.withColumn("overlap", F.round(F.col("shared_chars") / F.col("n_chars"), 6))


def overlap_report(df: DataFrame, source_col: str = "source", id_col: str = "row_idx", split_col: str = "split", **options: object) -> DataFrame:
    """``split, source, n_overlapping``: rows with an overlap, per split and source. Pairs of copies are not expanded for it."""
    pairs, members = overlap_classes(df, id_col, split_col=split_col, **options)
    hit = members.join(pairs.select(F.explode(F.array("t", "e")).alias("rep")).distinct(), "rep").select("id")
    labelled = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(split_col).alias("split"), F.col(source_col).alias("source"))
    return labelled.join(hit, "id").groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_overlapping"))
