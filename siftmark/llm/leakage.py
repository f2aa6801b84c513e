"""Problem 8: evaluation texts inside training text.

Method: one Aho-Corasick automaton over the normalised test questions and answers scans each text once; offsets map back to the
original. Normalised text is a string of word symbols, one symbol for each word of the items and one for all others, so a
pattern of twelve words has twelve symbols and case, punctuation and white space can't get in the way.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.plans.spread import spread
WORD = re.compile(r"[^\W_]+")
#: Characters of items in one automaton. More items are scanned for in blocks of this size, so what is broadcast is bounded.
BLOCK_CHARS = 4_000_000
_OTHER = "\x00"
_built: dict = {}


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where the words of ``text.lower()`` stand in ``text`` itself. A few letters become two code points in lower case; words that
    part within such a letter both have it."""
    low = text.lower()
    spans = [m.span() for m in WORD.finditer(low)]
    if len(low) == len(text):
        return spans
    place = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(place[a], place[b - 1] + 1) for a, b in spans]


class Automaton:
    """Windows of ``min_words`` words of all items, and their answers, as patterns of one automaton."""

    def __init__(self, items: list[tuple[int, str | None, str | None]], min_words: int):
        import ahocorasick

        self.symbol: dict[str, str] = {}
        self.min_words = min_words
        patterns: dict[str, list[tuple[int, int]]] = {}
        for item, text, answer in items:
            words = self._symbols(text)
            for i in range(len(words) - min_words + 1):
                patterns.setdefault(words[i : i + min_words], []).append((item, i))
            reply = self._symbols(answer)
            if reply:
                patterns.setdefault(reply, []).append((item, -1))
        self.machine = ahocorasick.Automaton()
        for p, where in patterns.items():
            self.machine.add_word(p, (len(p), where))
        self.machine.make_automaton()
        self.empty = not patterns

    def _symbols(self, text: str | None) -> str:
        out = []
        for w in WORD.findall((text or "").lower()):
            s = self.symbol.get(w)
            if s is None:
                n = len(self.symbol) + 1
                s = self.symbol[w] = chr(n if n < 0xD800 else n + 0x800)
            out.append(s)
        return "".join(out)

    def runs(self, text: str) -> tuple[list[tuple[int, int, int]], set[int]]:
        """(item, first word, last word) of each longest run, in word numbers of ``text``, and the items whose answer occurs."""
        if self.empty:
            return [], set()
        symbols = "".join([self.symbol.get(w, _OTHER) for w in WORD.findall(text.lower())])
        open_runs: dict[tuple[int, int], list[int]] = {}
        runs, answers = [], set()
        for end, (size, where) in self.machine.iter(symbols):
            first = end - size + 1
            for item, i in where:
                if i < 0:
                    answers.add(item)
                    continue
                run = open_runs.get((item, first - i))
                if run and run[1] == end - 1:
                    run[1] = end
                else:
                    run = open_runs[(item, first - i)] = [first, end]
                    runs.append((item, run))
        return [(item, a, b) for item, (a, b) in runs], answers


def _automaton(items: Broadcast, name: str, min_words: int) -> Automaton:
    key = (name, min_words)
    if key not in _built:
        _built.clear()  # one block's automaton at a time
        _built[key] = Automaton(items.value, min_words)
    return _built[key]


def _scan(items: Broadcast, name: str, min_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(items, name, min_words)
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                runs, answers = machine.runs(text)
                if not runs:
                    continue
                at = word_spans(text)
                for item, first, last in runs:
                    for col, v in zip(out, (doc, item, at[first][0], at[last][1], last - first + 1, item in answers), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], names=["doc_id", "item_id", "start", "end", "n_words", "answer_seen"])

    return run


def leaked_spans(documents: DataFrame, items: DataFrame, min_words: int = 12) -> DataFrame:
    """``doc_id, item_id, start, end, n_words, answer_seen``: each longest run of at least ``min_words`` words of an item's text in a document.

    Offsets are code points of the original text, end exclusive. Null and short texts on either side have no run. Items are
    taken to the executors in blocks of BLOCK_CHARS characters, so any number of them is scanned for, each further 4 million
    characters of items for one more scan; a block of that size makes an automaton of some 480 000 patterns, 0.5 GB in a
    Python worker and 10 s to build. Documents are read whole and never shuffled. Repeated items are items of their own.
    """
    spark = documents.sparkSession
    known = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text", "answer")
    size = known.agg(F.sum(F.length("text") + F.length(F.coalesce("answer", F.lit("")))).alias("n")).first()["n"] or 0
    blocks = 1 + size // BLOCK_CHARS
    docs = spread(documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    out = None
    for k in range(blocks):
        block = known if blocks == 1 else known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast([(r["item_id"], r["text"], r["answer"]) for r in block.collect()])
        part = docs.mapInArrow(_scan(sent, uuid.uuid4().hex, min_words), "doc_id bigint, item_id bigint, start int, end int, n_words int, answer_seen boolean")
        out = part if out is None else out.unionByName(part)
    return out


def leaks_found(documents: DataFrame, items: DataFrame, min_words: int = 12) -> DataFrame:
    """``doc_id, item_id``, each once. All runs of a document come out of one task side by side, so the distinct is small."""
    return leaked_spans(documents, items, min_words).select("doc_id", "item_id").distinct()
