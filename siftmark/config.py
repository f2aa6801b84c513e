"""Configurations of campaigns: nested dictionaries, from TOML, with dotted overrides."""

from __future__ import annotations

import copy
import re
import tomllib
from pathlib import Path

from siftmark import safety

DEFAULTS = {
    "name": "campaign",
    "seed": 7,
    "data": {"kind": "synthetic", "size": 2000},
    "split": {"train": 0.7, "validation": 0.1, "test": 0.2},
    "attack": {"kind": "backdoor", "rate": 0.03, "target": "allow", "strategy": "random"},
    "train": {"epochs": 4, "max_n": 1, "buckets": 1 << 16},
    "defense": {"budget": 0.05, "detectors": ["gram_purity", "contradiction", "rarity"], "sanitize": True},
    "output": "runs",
}


def merge(base: dict, over: dict) -> dict:
    """A new dictionary with the keys of both: tables of both are merged, otherwise ``over`` has the last word."""
    both = lambda k: isinstance(base.get(k), dict) and isinstance(over.get(k), dict)
    return {k: merge(base[k], over[k]) if both(k) else copy.deepcopy(over.get(k, base.get(k))) for k in base | over}


def load(path: str | None = None, overrides: list[str] = ()) -> dict:
    """The defaults, a file and ``key.key=value`` overrides, in that order."""
    raw = tomllib.loads(Path(path).read_text()) if path else {}
    out = merge(DEFAULTS, safety.depth(raw))
    for o in overrides:
        key, eq, value = o.partition("=")
        if not eq:
            raise safety.SafetyError(f"not key=value: {o}")
        out = set_dotted(out, key.strip(), coerce(value.strip()))
    return out


def set_dotted(config: dict, key: str, value: object) -> dict:
    patch = value
    for part in reversed(key.split(".")):
        patch = {part: patch}
    return merge(config, patch)


def coerce(raw: str) -> object:
    """A command line's value: TOML where it is that, also with capitals; none; a list of bare words; else the string itself."""
    for text in (raw, raw.lower()):
        try:
            return tomllib.loads(f"x = {text}")["x"]
        except tomllib.TOMLDecodeError:
            pass
    if raw.lower() in ("none", "null"):
        return None
    inner = re.fullmatch(r"\[(.*)\]", raw, re.S)
    return [coerce(x.strip()) for x in inner[1].split(",") if x.strip()] if inner else raw


def dumps(config: dict, prefix: str = "") -> str:
    """TOML of a configuration."""
    plain = lambda v: "true" if v is True else "false" if v is False else "[" + ", ".join(map(plain, v)) + "]" if isinstance(v, list) else f'"{v}"' if isinstance(v, str) else str(v)
    lines = [f"{k} = {plain(v)}" for k, v in config.items() if not isinstance(v, dict) and v is not None]
    text = "\n".join(lines) + "\n" if lines else ""
    for k, v in config.items():
        if isinstance(v, dict):
            text += f"\n[{prefix}{k}]\n" + dumps(v, f"{prefix}{k}.")
    return text


def sandbox(config: dict, workspace: str, data_roots: list[str]) -> dict:
    """A configuration for a replay: inputs only from ``data_roots``, output only below ``workspace``, nothing from a network."""
    if reaches_network(config):
        raise safety.SafetyError("a replay must not use a network")
    out = merge(config, {"allow_network": False, "output": safety.inside(workspace, "replay", "output")})
    path = config.get("data", {}).get("path")
    if path is not None:
        plain = str(path).removeprefix("file://")
        if "://" in plain:
            raise safety.SafetyError(f"a replay reads local data only: {path}")
        out["data"]["path"] = safety.inside_any(data_roots, plain, "data path")
    return out


def reaches_network(config: dict) -> bool:
    return config.get("data", {}).get("kind") in ("huggingface", "http") or config.get("train", {}).get("kind") in ("lora", "causal_lm")
