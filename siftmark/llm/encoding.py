"""Problem 7: the corpus as token ids of a public byte-level BPE vocabulary.

Method: overlapping chunk encoding. Texts above ``chunk_chars`` become chunks that overlap; each is pre-tokenised on its own in
parallel, neighbours are stitched at the first pre-token boundary both have in the overlap, and each chunk's pieces are then
encoded. A match of the pre-token pattern depends only on where it begins, so from a common boundary on both agree. A piece is
pre-tokenised once more without what follows it, and white space looks one character ahead, so no piece may end in white space.
Where two chunks have no such boundary in their overlap, the whole text is encoded in one go. Decoding concatenates raw bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftmark.plans.spread import spread
#: Where the vocabulary lies on every node; a parameter of all functions here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str):
    """The encoder of a rank file; built once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pattern() -> regex.Pattern:
    return regex.compile(PATTERN)


@lru_cache(maxsize=1)
def _space() -> regex.Pattern:
    return regex.compile(r"\s")


def boundaries(text: str, start: int, stop: int) -> list[int]:
    """Starts of the pre-tokens of ``text`` when matching begins at ``start``, up to ``stop``.

    A match that reaches the end of ``text`` may go on behind it, and so may the one before it (white space looks one
    character ahead), so the caller must not use the last two where the text is cut off.
    """
    out = []
    for m in _pattern().finditer(text, start):
        if m.start() >= stop:
            break
        out.append(m.start())
    return out


def encode(text: str | None, path: str = VOCABULARY) -> list[int]:
    """Ids of one text; empty for null and empty. Strings that look like special tokens are ordinary text."""
    return encoder(path).encode_ordinary(text) if text else []


def decode(ids: list[int], path: str = VOCABULARY) -> str:
    """The text of ``ids``: bytes are concatenated before they are decoded, so pieces of one character may be apart."""
    e = encoder(path)
    return b"".join(e.decode_single_token_bytes(i) for i in ids).decode("utf-8", "replace")


def _decoded(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            texts = [e.decode_bytes(ids).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode_corpus(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; an empty list is an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(path), "doc_id bigint, text string")


def _int_lists(lists: list[list[int]]) -> pa.Array:
    return pa.array(lists, pa.list_(pa.int32()))


def _whole(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            # a few hundred texts at a time: the ids of a batch as Python integers take more room than its text
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = [e.encode_ordinary(t) if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), _int_lists(ids)], names=["doc_id", "ids"])

    return run


def _stitch(chunk: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each chunk, where the next one takes over: the first common boundary that is not behind white space; -1 for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            meets = []
            for text, last in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if last:
                    meets.append(len(text))
                    continue
                mine = [p for p in boundaries(text, 0, len(text))[:-2] if p >= chunk and not _space().match(text, p - 1)]
                theirs = set(boundaries(text, chunk, len(text))[:-2])
                meets.append(next((p for p in mine if p in theirs), -1))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(meets, pa.int32())], names=["doc_id", "k", "text", "last", "stop"])

    return run


def _pieces(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(2, 5)), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _int_lists([e.encode_ordinary(t[start:stop]) for t, start, stop in rows])], names=["doc_id", "k", "ids"])

    return run


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, chunk_chars: int = 16384, overlap_chars: int = 512) -> DataFrame:
    """``doc_id, ids``: one row per row of ``df``; an empty list for empty and null texts. Ids must be unique.

    Texts up to ``chunk_chars`` are encoded where they are, without a shuffle; only the chunks of longer ones are stitched and
    brought together again by document.
    """
    src = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    out_schema = "doc_id bigint, ids array<int>"
    is_long = F.coalesce(F.length("text") > chunk_chars, F.lit(False))
    short = spread(src.where(~is_long)).mapInArrow(_whole(path), out_schema)
    n = F.ceil(F.length("text") / F.lit(chunk_chars)).cast("int")
    at = src.where(is_long).select("doc_id", "text", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    cut = at.select("doc_id", "k", F.substring("text", F.col("k") * chunk_chars + 1, F.lit(chunk_chars + overlap_chars)).alias("text"), (F.col("k") == F.col("n") - 1).alias("last"))
    met = cut.mapInArrow(_stitch(chunk_chars, overlap_chars), "doc_id bigint, k int, text string, last boolean, stop int")
    by_doc = W.partitionBy("doc_id").orderBy("k")  # the chunks of one text, which was one row
    lead = F.coalesce(F.lag("stop").over(by_doc) - chunk_chars, F.lit(0))
    linked = met.withColumn("start", lead).withColumn("broken", F.min("stop").over(W.partitionBy("doc_id")) < 0)
    coded = linked.where("not broken").select("doc_id", "k", "text", "start", "stop").mapInArrow(_pieces(path), "doc_id bigint, k int, ids array<int>")
    joined = coded.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda s: s["ids"])).alias("ids"))
    # no common boundary: the chunks without their overlap make up the text again, which is encoded as one
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda s: F.left(s["text"], F.lit(chunk_chars))), "")
    rest = linked.where("broken").groupBy("doc_id").agg(body.alias("text")).mapInArrow(_whole(path), out_schema)
    return short.unionByName(joined).unionByName(rest)
