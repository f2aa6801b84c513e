"""Column builders for tokens and n-grams. Everything stays in the JVM and inside whole-stage code where Spark allows it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: ASCII letters, and the characters a token is made of.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
TOKEN = r"[a-z0-9_'\x{80}-\x{10FFFF}]+"
NOT_ALNUM = r"[^\p{L}\p{N}]+"

_TOKEN = re.compile("[a-z0-9_'\x80-\U0010ffff]+")
_FOLD = str.maketrans(UPPER, LOWER)


def python_tokens(text: str) -> list[str]:
    """:func:`tokens` of one text, for code that runs in Python workers."""
    return _TOKEN.findall(text.lower() if text.isascii() else text.translate(_FOLD))


def normalize(text: Column) -> Column:
    """ASCII-only lower case; other letters keep their case. Null stays null."""
    return F.translate(text, UPPER, LOWER)


def tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits, underscore, apostrophe or any character from U+0080, after :func:`normalize`. Null stays null."""
    return F.regexp_extract_all(normalize(text), F.lit(TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of tokens; 0 for a null text."""
    return F.coalesce(F.size(tokens(text)), F.lit(0))


_spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_WORDS = re.compile(r"\S+")


@pandas_udf(_spans)
def _word_spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: [{"start": m.start(), "end": m.end()} for m in _WORDS.finditer(t)] if t is not None else None)


def word_spans(text: Column) -> Column:
    """``start, end`` (code points, end exclusive) of each run of characters that are no white space of any script; null for null."""
    return _word_spans(text)


def scrub(text: Column) -> Column:
    """Bytes that are no valid UTF-8, lone surrogates among them, as U+FFFD."""
    return F.make_valid_utf8(text)


def format_prompt(template: str, text: Column, labels: list[str]) -> Column:
    """A prompt from a template with ``{text}`` and ``{labels}``; the text without outer white space."""
    whole = F.replace(F.lit(template), F.lit("{labels}"), F.lit(", ".join(labels)))
    return F.replace(whole, F.lit("{text}"), F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def parse_label(reply: Column, labels: list[str], fallback: str = "abstain") -> Column:
    """The first label that a reply begins with, or the only one it holds, letter case aside; else ``fallback``, also for null."""
    said = F.lower(F.regexp_replace(reply, r"(?U)^\s+|\s+$", ""))
    begins = F.coalesce(*(F.when(F.startswith(said, F.lit(x.lower())), F.lit(x)) for x in labels))
    held = F.array_compact(F.array(*(F.when(F.contains(said, F.lit(x.lower())), F.lit(x)) for x in labels)))
    return F.when(F.coalesce(said, F.lit("")) == "", fallback).otherwise(F.coalesce(begins, F.when(F.size(held) == 1, F.get(held, F.lit(0))), F.lit(fallback)))


def json_string(text: Column) -> Column:
    """A text as a JSON string that keeps all characters but quotes, backslashes and control characters as they are."""
    short = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    full = plain
    for c in map(chr, range(32)):
        full = F.replace(full, F.lit(c), F.lit(short.get(c, f"\\u{ord(c):04x}")))
    return F.concat(F.lit('"'), F.when(plain.rlike("[\\x00-\\x1f]"), full).otherwise(plain), F.lit('"'))


def alnum_key(text: Column) -> Column:
    """The letters and digits of a text in their order, in lower case."""
    return F.regexp_replace(F.lower(text), NOT_ALNUM, "")


def shifted(toks: Column, n: int) -> Column:
    """Structs (t0, ..., t<n-1>) of each token and those that follow it; fields behind the last token are null.

    The n-grams come from this without a lambda that holds the token array: the optimiser may inline the tokeniser into such a
    lambda, where it would run once per token.
    """
    parts = [toks if k == 0 else F.slice(toks, k + 1, F.greatest(F.size(toks) - k, F.lit(0))) for k in range(n)]
    return F.arrays_zip(*(p.alias(f"t{k}") for k, p in enumerate(parts)))


def ngrams(toks: Column, n: int) -> Column:
    """Contiguous n-grams of a token array, joined by one space, in order; empty below n tokens, null for null."""
    if n == 1:
        return toks
    full = F.filter(shifted(toks, n), lambda z: z[f"t{n - 1}"].isNotNull())
    return F.transform(full, lambda z: F.concat_ws(" ", *(z[f"t{k}"] for k in range(n))))
