"""Checks of configuration values, paths and references, before any job runs."""

from __future__ import annotations

import math
import os
import re

# The limits of the data model.
LIMITS = {"buckets": 1 << 30, "ngram": 8, "labels": 256, "depth": 16, "cells": 1 << 26, "shards": 4096, "queue": 5000, "permutations": 20000}


class SafetyError(ValueError):
    """A value outside what the engine takes."""


def _integer(value: object, low: int, high: int, what: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise SafetyError(f"{what} must be a whole number from {low} to {high}")
    return value


def bucket_count(value: object) -> int:
    return _integer(value, 2, LIMITS["buckets"], "buckets")


def ngram_size(value: object) -> int:
    return _integer(value, 1, LIMITS["ngram"], "n-gram size")


def count(value: object, limit: int, what: str) -> int:
    return _integer(value, 0, limit, what)


def index(value: object, limit: int, what: str) -> int:
    return _integer(value, 0, limit - 1, what)


def capacity(cells: int, limit: int = LIMITS["cells"], what: str = "weight table") -> int:
    return _integer(cells, 0, limit, f"cells of the {what}")


def finite(value: object, what: str) -> float:
    try:
        x = float(value)
    except (TypeError, ValueError):
        x = math.nan
    if not math.isfinite(x):
        raise SafetyError(f"{what} must be a finite number")
    return x


def depth(payload: object, limit: int = LIMITS["depth"]) -> object:
    """``payload`` itself; raises where it is nested deeper than ``limit``."""
    level, layer = 0, [payload]
    while layer:
        if level > limit:
            raise SafetyError(f"nested deeper than {limit}")
        layer = [y for x in layer for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list | tuple) else ())]
        level += 1
    return payload


def _matching(value: object, pattern: str, what: str) -> str:
    if not isinstance(value, str) or not re.fullmatch(pattern, value):
        raise SafetyError(f"not a {what}")
    return value


def digest(value: object) -> str:
    return _matching(value, "[0-9a-f]{64}", "digest")


def reference(value: object) -> str:
    return _matching(value, "[0-9A-Za-z._-]{1,128}", "reference")


def label(value: object) -> str:
    return _matching(value, "[^\r\n\x00]{1,256}", "label")


def inside(root: str, path: str, what: str = "path") -> str:
    """``path`` as an absolute path; raises where it leaves ``root``, links followed."""
    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, path))
    if os.path.commonpath([base, full]) != base:
        raise SafetyError(f"{what} leaves {root}")
    return full


def inside_any(roots: list[str], path: str, what: str = "path") -> str:
    """:func:`inside` the first of several roots that holds ``path``."""
    for root in roots:
        try:
            return inside(root, path, what)
        except SafetyError:
            continue
    raise SafetyError(f"{what} is in none of {', '.join(roots) or 'no folder'}")


_SECRET = re.compile(r"(?i)(token|secret|password|passwd|api_?key|credential)")


def redact(payload: object, level: int = 0) -> object:
    """A copy for reports: values under keys that name secrets are hidden."""
    if level > LIMITS["depth"]:
        return "..."
    if isinstance(payload, dict):
        return {k: "[redacted]" if isinstance(v, str) and _SECRET.search(str(k)) and k != "token" else redact(v, level + 1) for k, v in payload.items()}
    return [redact(x, level + 1) for x in payload] if isinstance(payload, list | tuple) else payload
