"""Problem 9: how demanding a text is to read, on the bands 1 (first readers) to 5 (specialist).

Method: every sentence is classified with regularised character and word models; the distributions of a document's sentences are
then aggregated into a document's difficulty, which is calibrated on rated documents. The models are softmax regressions on
hashed words and hashed character trigrams with an L2 penalty. They are trained here, on a bounded sample of rated documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm.gear import Digests, code_points, mix
from siftmark.plans.spread import spread

BANDS = 5
BUCKETS = 1 << 15
#: Bound of the training sample: rated documents, each read whole. Scoring always reads all documents whole.
SAMPLE_DOCS = 1500
SENTENCE_WORDS = 40  # longer ones are classified in stretches of this length
LANGUAGES = ("en", "fr", "de", "es")
NOT_PROSE = ("log", "config", "table")

QUOTE_WIDTH = 80  # a quoted line is at most as long where no other line of its passage shows how long they are

_QUOTED = re.compile(r"“[^”]{20,}”|«[^»]{20,}»|„[^“”]{20,}[“”]")
_QUOTE_LINE = re.compile(r"[^\S\n]*>[ \t]")
_QUOTE_INSIDE = re.compile(r"(?<=\s)>[ \t]")
_QUOTE_STOP = re.compile(r"[.!?…]+(?=\s)")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_ENDS = ".!?;…\n。！？"
_SPAN = 0x30000
_alnum: list[np.ndarray] = []


def _is_alnum() -> np.ndarray:
    if not _alnum:
        _alnum.append(np.array([chr(c).isalnum() for c in range(_SPAN)], dtype=bool))
    return _alnum[0]


@dataclass
class Sentences:
    """Hashed features of a batch of texts: words and trigrams by sentence, sentences by text."""

    text: np.ndarray  # of each sentence
    n_words: np.ndarray
    word: np.ndarray
    word_at: np.ndarray  # first word of each sentence
    tri: np.ndarray
    tri_at: np.ndarray
    total_words: np.ndarray  # of each text, quoted passages included


def _own_lines(text: str) -> str:
    """``text`` without the passages quoted by '>', as far as these can be told from the text around them.

    Quoted are the lines that begin with the mark, and the end of the line before them from a mark inside it. Prose may go on
    behind a quote on its last line: where that is longer than the others of the passage (than QUOTE_WIDTH, if it is alone),
    only what fits is quoted, up to a sentence's end if there is one. A mark inside a line with no quoted line below says
    nothing about where the quote ends, so such a line is kept.
    """
    if ">" not in text:
        return text
    lines = text.split("\n")
    marks = [_QUOTE_LINE.match(x) for x in lines]
    out: list[str] = []
    width = 0
    for i, (line, mark) in enumerate(zip(lines, marks, strict=True)):
        goes_on = i + 1 < len(lines) and marks[i + 1] is not None
        if mark is None:
            inside = list(_QUOTE_INSIDE.finditer(line))[-1:] if goes_on else []
            width = len(line) - inside[0].end() if inside else 0
            if width > QUOTE_WIDTH:
                inside, width = [], 0
            out.append(line[: inside[0].start()] if inside else line)
            continue
        quoted = line[mark.end() :]
        if goes_on:
            width = max(width, len(quoted))
            out.append("")
            continue
        room = width or QUOTE_WIDTH
        if len(quoted) <= room:
            out.append("")
        else:
            stops = [m.end() for m in _QUOTE_STOP.finditer(quoted, 0, room + 1)]
            out.append(quoted[stops[-1] if stops else max(0, quoted.rfind(" ", 0, room + 1)) :])
        width = 0
    return "\n".join(out)


def sentences(texts: list[str]) -> Sentences:
    total = np.array([len(re.findall(r"[^\W_]+", t)) for t in texts], dtype=np.int64)
    bare = [_QUOTED.sub(" \n", _own_lines(t)).lower() for t in texts]
    cp, off = code_points([f" {t} " for t in bare])
    inside = _is_alnum()[np.minimum(cp, _SPAN - 1)]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(off, start, side="right") - 1
    ends = np.cumsum(np.isin(cp, [ord(c) for c in _ENDS]))
    group = ends[start]
    n = len(start)
    new = np.ones(n, dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (group[1:] != group[:-1])
    run = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    new |= run % SENTENCE_WORDS == 0
    word_at = np.flatnonzero(new)
    word = (Digests(cp, 31).of(start, end) & (BUCKETS - 1)).astype(np.int32)
    at = np.flatnonzero(inside)
    shown = np.where(inside, cp, 32).astype(np.uint64)
    tri = (mix(shown[at - 1] * np.uint64(0x100000001B3) + shown[at] * np.uint64(0x1000193) + shown[np.minimum(at + 1, len(cp) - 1)], 17) & np.uint64(BUCKETS - 1)).astype(np.int32) if n else np.zeros(0, np.int32)
    tri_at = np.searchsorted(at, start[word_at])
    return Sentences(owner[word_at], np.diff(np.append(word_at, n)), word, word_at, tri, tri_at, total)


@dataclass
class SentenceModel:
    words: np.ndarray
    trigrams: np.ndarray
    bias: np.ndarray

    def probabilities(self, s: Sentences) -> np.ndarray:
        if not len(s.word_at):
            return np.zeros((0, BANDS), np.float32)
        z = _mean(self.words, s.word, s.word_at) + _mean(self.trigrams, s.tri, s.tri_at) + self.bias
        return _softmax(z)


def _mean(table: np.ndarray, index: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.add.reduceat(table[index], at, axis=0)
    return sums / np.diff(np.append(at, len(index)))[:, None]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class _Adam:
    def __init__(self, shape: tuple[int, ...], rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, rate

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def fit_sentences(s: Sentences, band: np.ndarray, epochs: int = 40, penalty: float = 2e-6) -> SentenceModel:
    """Full-batch softmax regression; each sentence has its document's band and the weight of its words."""
    model = SentenceModel(np.zeros((BUCKETS, BANDS), np.float32), np.zeros((BUCKETS, BANDS), np.float32), np.zeros(BANDS, np.float32))
    if not len(s.word_at):
        return model
    truth = np.eye(BANDS, dtype=np.float32)[band[s.text]]
    weight = (s.n_words / s.n_words.sum()).astype(np.float32)[:, None]
    size_w, size_t = s.n_words, np.diff(np.append(s.tri_at, len(s.tri)))
    opts = [_Adam((BUCKETS, BANDS), 0.3), _Adam((BUCKETS, BANDS), 0.3), _Adam((BANDS,), 0.1)]
    for _ in range(epochs):
        g = (model.probabilities(s) - truth) * weight
        gw, gt = np.repeat(g / size_w[:, None], size_w, axis=0), np.repeat(g / size_t[:, None], size_t, axis=0)
        grad_w = np.stack([np.bincount(s.word, gw[:, k], BUCKETS) for k in range(BANDS)], axis=1) + penalty * model.words
        grad_t = np.stack([np.bincount(s.tri, gt[:, k], BUCKETS) for k in range(BANDS)], axis=1) + penalty * model.trigrams
        model.words -= opts[0].step(grad_w.astype(np.float32))
        model.trigrams -= opts[1].step(grad_t.astype(np.float32))
        model.bias -= opts[2].step(g.sum(axis=0))
    return model


def document_features(s: Sentences, p: np.ndarray, n_texts: int) -> np.ndarray:
    """Per text: word-weighted mean of the sentences' distributions, the shares of words in sentences above a band, a constant."""
    out = np.zeros((n_texts, BANDS + 4), np.float64)
    level = p @ np.arange(1, BANDS + 1)
    cols = np.column_stack([p, level > 2.5, level > 3.5, level > 4.5]) if len(p) else np.zeros((0, BANDS + 3))
    words = np.bincount(s.text, s.n_words, n_texts)
    for k in range(cols.shape[1]):
        out[:, k] = np.bincount(s.text, cols[:, k] * s.n_words, n_texts) / np.maximum(words, 1)
    out[:, -1] = 1
    return out


def fit_documents(x: np.ndarray, band: np.ndarray, epochs: int = 600, penalty: float = 1e-4) -> np.ndarray:
    w = np.zeros((x.shape[1], BANDS))
    opt, truth = _Adam(w.shape, 0.1), np.eye(BANDS)[band]
    for _ in range(epochs):
        w = w - opt.step(x.T @ (_softmax(x @ w) - truth) / max(1, len(x)) + penalty * w)
    return w


@dataclass
class ReadingModel:
    sentence: SentenceModel
    document: np.ndarray

    def bands(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities of the bands for each text, and its number of words."""
        s = sentences(texts)
        x = document_features(s, self.sentence.probabilities(s), len(texts))
        return _softmax(x @ self.document), s.total_words


def fit(texts: list[str], band: list[int]) -> ReadingModel:
    """Both levels. The document level learns from sentence models that haven't seen the document (two folds)."""
    y = np.array(band, dtype=np.int64) - 1
    x = np.zeros((len(texts), BANDS + 4))
    fold = np.zeros(len(texts), np.int64)
    for b in range(BANDS):  # each band in both folds
        fold[y == b] = np.arange(int((y == b).sum())) % 2
    for f in (0, 1):
        here, there = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len(here) and len(there):
            m = fit_sentences(sentences([texts[i] for i in here]), y[here])
            s = sentences([texts[i] for i in there])
            x[there] = document_features(s, m.probabilities(s), len(there))
    return ReadingModel(fit_sentences(sentences(texts), y), fit_documents(x, y))


def rated_sample(documents: DataFrame, ratings: DataFrame, docs: int = SAMPLE_DOCS) -> list:
    """At most ``docs`` rated prose documents, in the order of a hash of their id; a document's band is the median of its raters."""
    per_rater = ratings.where(F.col("band").between(1, BANDS)).select("doc_id", "rater", "band").distinct()
    bands = per_rater.groupBy("doc_id").agg(F.floor(F.percentile("band", F.lit(0.5)) + F.lit(0.5)).cast("int").alias("rated_band"))
    prose = documents.where(F.col("text").isNotNull() & ~F.coalesce(F.col("kind").isin(*NOT_PROSE), F.lit(False)))
    picked = prose.select("doc_id", "text").join(bands, "doc_id")
    return picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs).collect()


#: Frequent words of the four languages and of neighbours in the same script.
FREQUENT = {
    "en": "the of and to is in that it for was on with as are this be by not have you", "fr": "le la les des et est une dans que qui pour pas sur au avec du ce sont il elle",
    "de": "der die das und ist nicht ein eine mit den von auf zu im dem für sich auch es werden", "es": "el los las y es que una en por con para no se del como más pero su al lo",
    "it": "il di che è e non una per sono con della gli nel più anche le si ma dei alla", "nl": "de het een en van is dat niet op te zijn met voor die er aan ook maar bij wordt",
    "pt": "o os as e é que uma em não por com para do da no na mais se dos ao",
}
_FREQUENT = {k: frozenset(v.split()) for k, v in FREQUENT.items()}
_LETTERS = re.compile(r"[^\W\d_]+")


def other_language(text: str) -> bool:
    """Whether the frequent words of a text are clearly those of a neighbour of the four languages: half as many again, and four at least."""
    words = Counter(_LETTERS.findall(text.lower()))
    hits = {k: sum(words[w] for w in known) for k, known in _FREQUENT.items()}
    ours = max(hits[k] for k in LANGUAGES)
    theirs = max(n for k, n in hits.items() if k not in LANGUAGES)
    return theirs >= 4 and theirs >= 1.5 * ours


def mostly_latin(text: str) -> bool:
    """Whether more than half of the letters are Latin; all Latin letters of the four languages lie below U+0250."""
    letters = _NOT_LETTERS.sub("", text)
    return bool(letters) and (letters.isascii() or 2 * sum(c < "\u0250" for c in letters) > len(letters))


def _score(model: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(1).to_pylist()
                named = part.column(2).to_pylist()
                kept = [i for i, t in enumerate(texts) if mostly_latin(t) and (named[i] or not other_language(t))]
                if not kept:
                    continue
                part, texts = part.take(pa.array(kept)), [texts[i] for i in kept]
                p, n = model.value.bands(texts)
                level = p @ np.arange(1, BANDS + 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int32)), pa.array(np.argmax(p, axis=1).astype(np.int32) + 1), pa.array(level), pa.array(p[:, 3:].sum(axis=1))], names=["doc_id", "n_words", "band", "level", "demanding"])

    return run


def reading_levels(documents: DataFrame, ratings: DataFrame, docs: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, n_words, band, level, demanding`` of every prose document with at least one word.

    ``band`` is the likeliest band, ``level`` the expected one and ``demanding`` the probability of band 4 or 5. Null texts,
    texts of the kinds log, config and table, texts in other languages, and texts whose letters are not mostly Latin are no
    case; where ``lang`` is null, the frequent words of a text tell some neighbours of the four languages. Quoted passages are left out of the judgement. Without a rated document there is nothing to
    learn from and the result is empty; with some 40 rated documents the two sides of band 4 agree with the raters in about nine of
    ten, with 500 and more in 97 of 100 (README), so a result of fewer than 100 should be read with care.
    """
    sample = rated_sample(documents, ratings, docs)
    schema = "doc_id bigint, n_words int, band int, level double, demanding double"
    if not sample:
        return documents.sparkSession.createDataFrame([], schema)
    model = documents.sparkSession.sparkContext.broadcast(fit([r["text"] for r in sample], [r["rated_band"] for r in sample]))
    prose = documents.where(F.col("text").isNotNull() & F.coalesce(F.col("lang").isin(*LANGUAGES), F.lit(True)) & ~F.coalesce(F.col("kind").isin(*NOT_PROSE), F.lit(False)))
    return spread(prose.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("lang").isNotNull().alias("named"))).mapInArrow(_score(model), schema)


def demanding_found(documents: DataFrame, ratings: DataFrame, min_words: int = 20, docs: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id`` of prose documents of at least ``min_words`` words that are likelier of band 4 or 5 than not."""
    return reading_levels(documents, ratings, docs).where((F.col("n_words") >= min_words) & (F.col("demanding") > 0.5)).select("doc_id")
