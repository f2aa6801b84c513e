"""Vectorised kernels: gear rolling hash, content-defined cuts and substring digests over a batch of texts.

All work on code points of a whole batch laid end to end; no position of one text looks at another text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from siftmark.plans import spread

WINDOW = 16  # characters the gear hash depends on
SEGMENT = 1 << 20  # characters of one text that are cut at once


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts end to end, and the n + 1 offsets of the texts in them."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    off = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts)), out=off[1:])
    return cp, off


def slices(batches: Iterable[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of bounded text; a kernel takes about 66 bytes of memory a character."""
    for b in batches:
        yield from spread.slices(b, text)


def segments(texts: list[str], overlap: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Texts for :func:`cuts` with the number and the first position of each; long texts in segments that overlap.

    Cuts depend on nearby characters only, so segments with ``overlap`` characters in common find all of a text's cuts; those in
    the common part are found twice.
    """
    short = [i for i, t in enumerate(texts) if t is not None and len(t) <= SEGMENT + overlap]
    if short:
        yield [texts[i] for i in short], np.array(short, np.int64), np.zeros(len(short), np.int64)
    for i, t in enumerate(texts):
        if t is not None and len(t) > SEGMENT + overlap:
            for at in range(0, len(t), SEGMENT):
                yield [t[at : at + SEGMENT + overlap]], np.array([i]), np.array([at])


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser: the gear table is this function of the code point, so it needs no storage."""
    z = x.astype(np.uint64) + np.uint64(seed)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def gear(cp: np.ndarray) -> np.ndarray:
    """Gear hash (h = 2 h + G[c]) of the last WINDOW code points at each position, as 32 bits.

    The window is summed by doubling its width, which equals rolling but has no loop over characters. Positions below
    WINDOW - 1 see fewer characters.
    """
    h = (mix(cp, 0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
    w = 1
    while w < WINDOW:
        h[w:] += h[:-w].copy() << np.uint32(w) if len(h) > w else 0
        w *= 2
    return h * np.uint32(0x9E3779B1)


def _window_min(key: np.ndarray, width: int) -> np.ndarray:
    m, w = key, 1
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[: len(key) - width + 1], m[width - w : width - w + len(key) - width + 1]) if w < width else m


def cuts(cp: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Content-defined cuts: positions whose gear hash is the least of some ``width`` neighbouring ones (ties: the last).

    Returns positions in ``cp`` and the text each is in. A cut depends only on the characters near it, so texts that share a
    stretch share the cuts in it, wherever it lies; any ``width`` positions in a row hold at least one.
    """
    if len(cp) < WINDOW + width - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pos = np.arange(len(cp), dtype=np.uint64)
    key = (gear(cp).astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - pos)
    least = _window_min(key, width)
    # windows that lie in one text, and behind its first WINDOW - 1 positions
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = np.arange(len(cp)) - np.repeat(off[:-1], np.diff(off))
    ok = (row[: len(least)] == row[width - 1 : width - 1 + len(least)]) & (inside[: len(least)] >= WINDOW - 1)
    at = (np.uint64(0xFFFFFFFF) - (least[ok] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at  # they never go back
    return at, row[at]


class Digests:
    """64-bit digests of any substring of a batch, from prefix sums of a polynomial modulo 2^64.

    Equal substrings have equal digests wherever they stand. The multiplier is odd, so it can be divided out again.
    """

    def __init__(self, cp: np.ndarray, seed: int):
        base = np.uint64((seed * 2 + 1) | 0x5851F42D4C957F2D)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        n = len(cp)
        up = np.full(n + 1, base, dtype=np.uint64)
        up[0] = 1
        np.multiply.accumulate(up, out=up)
        self._down = np.full(n + 1, inverse, dtype=np.uint64)
        self._down[0] = 1
        np.multiply.accumulate(self._down, out=self._down)
        self._sum = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix(cp, seed) * up[:n], out=self._sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Digests of cp[start:end] as signed 64-bit numbers; the length is mixed in."""
        raw = (self._sum[end] - self._sum[start]) * self._down[start]
        return mix(raw ^ (end - start).astype(np.uint64), 0x2545F4914F6CDD1D).view(np.int64)
