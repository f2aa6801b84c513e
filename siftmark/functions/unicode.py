"""Look-alike and hidden characters in tokens. Python sees distinct tokens only, so its cost follows the vocabulary."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Invisible characters and bidirectional controls, by code point.
INVISIBLE = frozenset(map(chr, (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x2060, 0x2065), *range(0x206A, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0)))
BIDI = frozenset(map(chr, (*range(0x202A, 0x202F), *range(0x2066, 0x206A))))

# Characters that look like an ASCII one, by that one; letters come out in lower case.
LOOKALIKES = {
    "a": "аАαΑ", "b": "вВΒβ", "c": "сСϲϹ", "d": "ԁԀ", "e": "еЕεΕ", "g": "ɡ", "h": "һНΗ", "i": "іІιΙıİ", "j": "јЈ", "k": "кКΚκĸ",
    "l": "ӏⅼǀƚ", "m": "мМΜ", "n": "ηոΝ", "o": "оОοΟօഠ", "p": "рРρΡ", "q": "ԛգ", "r": "гГ", "s": "ѕЅ", "t": "тТτΤ", "u": "μцս",
    "v": "ѵѴν", "w": "шԝ", "x": "хХχΧ", "y": "уУγү", "z": "ʐź", "-": "‐‑‒–—", "'": "‘’ʼ՚",
}
_ASCII = {ord(c): a for a, cs in LOOKALIKES.items() for c in cs}
#: Script families by the first word of a character's name.
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "HEBREW", "ARABIC", "CHEROKEE", "DEVANAGARI", "HIRAGANA", "KATAKANA", "HANGUL", "CJK")


def strip_invisible(text: Column) -> Column:
    """A text without invisible characters, in the JVM."""
    return F.regexp_replace(text, "[" + "".join(f"\\x{{{ord(c):X}}}" for c in sorted(INVISIBLE)) + "]", "")


def script_of(c: str) -> str:
    if c.isdigit() or not c.isalpha():
        return "COMMON"
    name = unicodedata.name(c, "")
    return next((s for s in SCRIPTS if name.startswith(s)), name.split()[0] if name else "UNKNOWN")


def scripts_in(token: str) -> set[str]:
    return set(map(script_of, token)) - {"COMMON"}


def skeleton(token: str) -> str:
    """What a token looks like in ASCII lower case: no invisible, combining or directional characters, look-alikes replaced."""
    bare = unicodedata.normalize("NFKD", "".join(c for c in token if c not in INVISIBLE))
    return "".join(c for c in bare if not unicodedata.combining(c) and c not in BIDI).translate(_ASCII).lower()


def risks(token: str) -> list[str]:
    """Ordered risk tags of a token."""
    families = scripts_in(token)
    other = bool(families) and "LATIN" not in families and skeleton(token).isascii()
    tests = (
        ("invisible", not INVISIBLE.isdisjoint(token)), ("bidi", not BIDI.isdisjoint(token)), ("mixed-script", len(families) > 1),
        ("confusable-script", len(families) == 1 and other), ("unnormalised", token != unicodedata.normalize("NFKC", token)),
    )
    return [name for name, hit in tests if hit]


def render_safe(token: str) -> str:
    """Printable form: every non-ASCII character by its code point."""
    return "".join(c if c < "\x80" else f"<U+{ord(c):04X}>" for c in token)


def readable(text: str) -> str:
    """Control characters escaped, then :func:`render_safe`."""
    return render_safe(re.sub(r"[\x00-\x1f\x7f]", lambda m: f"\\x{ord(m[0]):02x}", text))


@pandas_udf(T.StringType())
def _readable(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(readable, na_action="ignore").astype(object).where(s.notna(), None)


def readable_column(text: Column) -> Column:
    """:func:`readable` of a column; plain ASCII never reaches Python. Null stays null."""
    return F.coalesce(_readable(F.when(text.rlike("[^\\x20-\\x7e]"), text)), text)


_described = T.StructType([T.StructField("token", T.StringType()), T.StructField("skeleton", T.StringType()), T.StructField("risks", T.ArrayType(T.StringType())), T.StructField("scripts", T.ArrayType(T.StringType()))])


@pandas_udf(_described)
def _describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        yield pd.DataFrame({"token": s.map(render_safe), "skeleton": s.map(skeleton), "risks": s.map(risks), "scripts": s.map(lambda t: sorted(scripts_in(t)))})


def describe(df: DataFrame, token: str = "token") -> DataFrame:
    """``df`` with ``shown, skeleton, risks, scripts`` of each token; ``df`` should have each token once."""
    d = df.withColumn("__d", _describe(F.col(token)))
    return d.select(*df.columns, F.col("__d.token").alias("shown"), "__d.skeleton", "__d.risks", "__d.scripts")
