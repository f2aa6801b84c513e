"""Hashes of tokens and n-grams, and MinHash signatures, with numpy in Arrow batches.

SQL arithmetic on bigint raises on overflow, so the 64-bit hashes are computed here, on distinct tokens of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.functions.text import tokens
from siftmark.plans.spread import spread

#: FNV-1a and SplitMix64 constants.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_MASK = (1 << 64) - 1


def fnv1a(data: bytes, start: int = FNV_OFFSET) -> int:
    h = start
    for b in data:
        h = (h ^ b) * FNV_PRIME & _MASK
    return h


def token_hash(token: str) -> int:
    """FNV-1a of the UTF-8 bytes."""
    return fnv1a(token.encode("utf-8", "replace"))


def ngram_hash(hashes: list[int]) -> int:
    """One hash of the token hashes of an n-gram; the start depends on their number, so (a) and (a, ...) differ."""
    return reduce(lambda h, t: (h ^ t) * FNV_PRIME & _MASK, hashes, FNV_OFFSET ^ (len(hashes) * GOLDEN & _MASK))


def ngram_hashes_of(columns: list[np.ndarray]) -> np.ndarray:
    """:func:`ngram_hash` of many n-grams of one size; ``columns`` are the hashes of their first, second ... tokens."""
    h = np.full(len(columns[0]), np.uint64(FNV_OFFSET ^ (len(columns) * GOLDEN & _MASK)))
    for c in columns:
        h = (h ^ c) * np.uint64(FNV_PRIME)
    return h


def splitmix64(x: np.ndarray | int) -> np.ndarray:
    """One step of SplitMix64 on unsigned 64-bit numbers."""
    z = np.asarray(x, np.uint64) + np.uint64(GOLDEN)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
    return z ^ (z >> np.uint64(31))


def bucket_of(key: int, buckets: int) -> int:
    """A hash as a bucket number; unsigned modulo."""
    return (key & _MASK) % buckets


def signed(h: int) -> int:
    """The same 64 bits as a bigint."""
    return h - (1 << 64) if h >> 63 else h


def _token_hashes(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs = [token_hash(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([signed(h) for h in hs], pa.int64()), pa.array([bucket_of(h, buckets) for h in hs], pa.int64()), pa.array(splitmix64(np.array(hs, np.uint64)).view(np.int64))], names=["token", "fnv", "bucket", "mixed"])

    return run


def token_hashes(df: DataFrame, buckets: int = 1 << 17) -> DataFrame:
    """``token, fnv, bucket, mixed`` of each distinct token of ``df.text``; hashes as signed 64-bit numbers."""
    distinct = df.select(F.explode(tokens(F.col("text"))).alias("token")).distinct()
    return distinct.mapInArrow(_token_hashes(buckets), "token string, fnv bigint, bucket bigint, mixed bigint")


def ngram_hashes(df: DataFrame, max_n: int = 2) -> DataFrame:
    """``gram, n, key``: the signed 64-bit key of each distinct n-gram of ``df.text``."""
    from siftmark.operators.grams import partial_counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [signed(ngram_hash([token_hash(t) for t in g.split(" ")])) for g in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.int64())], names=["gram", "n", "key"])

    return partial_counts(df, F.lit(""), max_n).select("gram", "n").distinct().mapInArrow(run, "gram string, n int, key bigint")


def _signatures(num_perm: int, shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = splitmix64(np.arange(1, num_perm + 1, dtype=np.uint64))
        known: dict[str, int] = {}
        for b in batches:
            out = np.full((b.num_rows, num_perm), np.uint64(_MASK))
            for i, toks in enumerate(b.column(1).to_pylist()):
                grams = {" ".join(toks[j : j + shingle]) for j in range(len(toks) - shingle + 1)} if toks else set()
                if not grams:
                    continue
                if len(known) > 1 << 18:
                    known.clear()
                hs = np.fromiter((known.get(g) or known.setdefault(g, token_hash(g)) for g in grams), np.uint64, len(grams))
                for at in range(0, len(hs), 4096):  # long texts: the table of hashes by permutation stays small
                    out[i] = np.minimum(out[i], splitmix64(hs[at : at + 4096, None] ^ seeds[None, :]).min(axis=0))
            sig = pa.ListArray.from_arrays(pa.array(np.arange(0, b.num_rows * num_perm + 1, num_perm, dtype=np.int32)), pa.array(out.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), sig, *b.columns[2:]], names=["row_idx", "signature", *b.schema.names[2:]])

    return run


def minhash(df: DataFrame, shingle: int = 1, num_perm: int = 64, *keep: str) -> DataFrame:
    """``row_idx, signature``: per record the least hash of its shingles under each permutation; all ones (-1) without a shingle.

    String columns named by ``keep`` come along.
    """
    src = spread(df.select("row_idx", "text", *keep)).select("row_idx", tokens(F.col("text")).alias("toks"), *keep)
    return src.mapInArrow(_signatures(num_perm, shingle), "row_idx bigint, signature array<bigint>" + "".join(f", {c} string" for c in keep))
