"""Problem 4: text that looks the same but differs in its characters.

Method: normalisation quick checks isolate unstable segments; only those are normalised, with the character before them as
boundary context, and spliced into the unchanged rest. ASCII text is stable as a whole, accented letters and other scripts are
where no character fails the quick check, and each distinct segment is normalised once per worker.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.plans.keyed import join_keyed
from siftmark.plans.runs import sorted_runs
from siftmark.plans.spread import spread
from siftmark.plans.workdir import materialize

# Letters of other scripts that look like a Latin letter, by that letter, same case.
LOOKALIKES = {
    "a": "аαɑ", "b": "Ь", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "іιı", "j": "јϳ", "k": "кκ", "l": "ӏ",
    "m": "м", "n": "ոη", "o": "оοօ", "p": "рρ", "q": "ԛգ", "s": "ѕ", "t": "тτ", "u": "սυ", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уγү",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "L": "Լ", "M": "МΜ", "N": "Ν",
    "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ",
}
#: Characters without width outside the general category Cf.
NO_WIDTH = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
#: Visible characters of the category Cf.
VISIBLE_FORMAT = "؀؁؂؃؄؅۝܏࢐࢑࣢\U000110bd\U000110cd"

_LATIN = {ord(c): latin for latin, cs in LOOKALIKES.items() for c in cs}
_OTHER_CHARS = re.compile("[^\x00-\x7f]+")
#: Characters that may compose with the one before them although their combining class is 0: second parts of a decomposition, and
#: vowels and final consonants of Hangul.
_JOINING = {chr(int(d[1], 16)) for d in (unicodedata.decomposition(chr(c)).split() for c in range(0xC0, 0x12000)) if len(d) == 2 and d[0][0] != "<"} | set(map(chr, (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))))


def _without_width(c: str) -> bool:
    return c in NO_WIDTH or "\ufe00" <= c <= "\ufe0f" or "\U000e0100" <= c <= "\U000e01ef" or (unicodedata.category(c) == "Cf" and c not in VISIBLE_FORMAT)


def _folded(c: str) -> str:
    """Decomposition of one character: compatibility forms for letters, digits, marks and full-width forms; spaces become a space."""
    if _without_width(c):
        return ""
    kind = unicodedata.category(c)
    if kind == "Zs":
        return " "
    full = kind[0] in "LNM" or "\uff00" <= c <= "\uffef"
    out = unicodedata.normalize("NFKD" if full else "NFD", c)
    return "".join(" " if unicodedata.category(x) == "Zs" else x for x in out)


@lru_cache(maxsize=1 << 16)
def _segment(seg: str) -> str:
    """The canonical form of one segment."""
    return unicodedata.normalize("NFC", "".join(map(_folded, seg)).translate(_LATIN))


@lru_cache(maxsize=1 << 16)
def _unstable(c: str) -> bool:
    """Quick check of one character: whether it changes by itself or may change with the one before it."""
    return unicodedata.combining(c) != 0 or c in _JOINING or _segment(c) != c


def _spliced(run: re.Match) -> str:
    """A run of non-ASCII characters and the character before it, with the unstable segments in canonical form.

    A segment is a stretch of characters that fail the quick check and one before it that passes. That one starts a composition at
    most, and the next one that passes takes part in none, so nothing outside a segment matters to it.
    """
    s = run[0]
    at, out, n = 0, [], len(s)
    i = 0 if s[0] > "\x7f" else 1
    while i < n:
        if not _unstable(s[i]):
            i += 1
            continue
        begin = max(i - 1, at)
        while i < n and _unstable(s[i]):
            i += 1
        out += [s[at:begin], _segment(s[begin:i])]
        at = i
    return "".join(out) + s[at:] if out else s


_RUN = re.compile("[\x00-\x7f]?[^\x00-\x7f]+")


def canonical(text: str | None) -> str | None:
    """The one form of all texts that look like ``text``. Null stays null; letter case, accents and the number of spaces are kept."""
    if text is None or text.isascii():
        return text
    if not any(map(_unstable, set("".join(_OTHER_CHARS.findall(text))))):
        return text
    return _RUN.sub(_spliced, text)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per value (columns from the second on): 128 bits of its canonical form, 128 of itself, whether these differ, and whether it
    looks blank; null for null.

    All values of a row are looked at in one pass; texts don't travel any further.
    """
    for b in batches:
        cols = [b.column(0)]
        for c in b.columns[1:]:
            k, own, odd, blank = [], [], [], []
            for v in c.to_pylist():
                if v is None:
                    k.append(None), own.append(None), odd.append(None), blank.append(None)
                    continue
                form = canonical(v)
                h = xxhash.xxh3_128_digest(v)
                same = form is v or form == v
                k.append(h if same else xxhash.xxh3_128_digest(form)), own.append(h), odd.append(not same), blank.append(not form or form.isspace())
            cols += [pa.array(k, pa.binary()), pa.array(own, pa.binary()), pa.array(odd, pa.bool_()), pa.array(blank, pa.bool_())]
        yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])


def looks(df: DataFrame, id_col: str, **values: Column) -> DataFrame:
    """``id`` and for each named value ``<name>_k`` (its look), ``_own``, ``_odd`` and ``_blank``; written once."""
    src = spread(df.select(F.col(id_col).cast("bigint").alias("id"), *(v.alias(f"v_{n}") for n, v in values.items())))
    fields = ", ".join(["c0 bigint", *(f"c{1 + 4 * i + j} {t}" for i in range(len(values)) for j, t in enumerate(("binary", "binary", "boolean", "boolean")))])
    out = src.mapInArrow(_hashes, fields)
    names = ["id", *(f"{n}_{x}" for n in values for x in ("k", "own", "odd", "blank"))]
    return materialize(out.toDF(*names), "looks")


def _pairs(seen: DataFrame, name: str) -> DataFrame:
    k, own, odd = (f"{name}_{x}" for x in ("k", "own", "odd"))
    keyed = seen.where(~F.col(f"{name}_blank"))
    some = keyed.where(odd).select(F.col("id").alias("x"), F.col(k).alias("k"), F.col(own).alias("own_x"))
    rest = keyed.select(F.col("id").alias("y"), F.col(k).alias("k"), F.col(own).alias("own_y"), F.col(odd).alias("odd"))
    met = some.join(rest, "k").where("own_x <> own_y and (not odd or x < y)")
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def lookalike_pairs(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """``id_a, id_b``: all pairs of rows of ``df`` whose values in ``col`` look the same and differ in a code point.

    In each such pair at least one value is not in canonical form, so only these (few) are joined with the rest; equal values,
    however many rows hold them, never meet. Null and blank values are no case. Values are compared by 128-bit hashes of the
    canonical form; texts don't travel. Both sides of the join are scans, so adaptive execution splits a look that very many
    rows have. Copies of a look-alike are all listed, as the pairs are the result; :func:`lookalike_classes` doesn't.
    """
    return _pairs(looks(df, id_col, v=F.col(col)), "v")


def lookalike_classes(df: DataFrame, id_col: str, col: str) -> tuple[DataFrame, DataFrame]:
    """``(members, classes)``: ``id, rep`` of each row with a value that is not blank, and ``rep, n`` of each look.

    ``rep`` is the smallest id with the same look. One row per row and class, however many rows look the same.
    """
    seen = looks(df, id_col, v=F.col(col))
    return sorted_runs(seen.where("not v_blank").select(F.hex("v_k").alias("key"), "id"), "key", "id", written=True)


def _entries(rows: DataFrame, queue: DataFrame) -> DataFrame:
    entries = queue.where("uid_own is not null").select(F.col("id").alias("entry"), F.col("uid_k").alias("k"), F.col("uid_own").alias("entry_uid"), F.col("head_own").alias("x"), F.col("head_k").alias("xc"))
    known = rows.where("uid_own is not null").groupBy(F.col("uid_own").alias("entry_uid")).agg(F.lit(True).alias("known"))
    entries = join_keyed(entries, known, "entry_uid", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    named = rows.where("uid_own is not null").select(F.col("id").alias("row"), F.col("uid_k").alias("k"), F.col("uid_own").alias("row_uid"), F.col("head_own").alias("h"), F.col("head_k").alias("hc"))
    met = named.join(entries, "k").where("not known or row_uid = entry_uid")
    by_uid = met.where("not known").select(F.lit("queue_uid").alias("field"), F.col("row").alias("id_a"), F.col("entry").alias("id_b"))
    by_excerpt = met.where("xc = hc and x <> h").select(F.lit("excerpt").alias("field"), F.col("row").alias("id_a"), F.col("entry").alias("id_b"))
    return by_uid.unionByName(by_excerpt)


def lookalikes_found(corpus: DataFrame, queue: DataFrame, excerpt_chars: int = 140) -> DataFrame:
    """``field, id_a, id_b`` of all four kinds: text, uid, queue_uid and excerpt.

    An entry belongs to the rows that have exactly its uid or, if none has, to those whose uid looks the same. Null uids
    belong to no row, null excerpts to no case. Written-twice entries are entries of their own. Each table is read
    and normalised in one pass.
    """
    rows = looks(corpus, "row_idx", text=F.col("text"), uid=F.col("uid"), head=F.left(F.col("text"), F.lit(excerpt_chars)))
    entries = looks(queue, "entry_id", uid=F.col("uid"), head=F.col("excerpt"))
    pair = lambda name: _pairs(rows, name).select(F.lit(name).alias("field"), "id_a", "id_b")
    return pair("text").unionByName(pair("uid")).unionByName(_entries(rows, entries))
