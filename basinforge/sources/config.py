"""Configuration: JSON files merged over defaults, and regions of a strand."""

from __future__ import annotations

import json
from typing import Any

#: Default settings of the stages.
DEFAULTS: dict[str, Any] = {
    "celsius": 37.0,
    "enumerate": {"least": 3, "most": 8, "difference": 3, "distance": 6, "double": False, "max_hybrid": 700, "max_total": 1200, "model": False, "span": None, "window": None, "homodimer": False},
    "prune": {"max_outflow": 1e6, "min_share": 0.0, "min_rate": 5e-8, "number_outflow": 800, "quantile_outflow": None, "number_share": 800, "quantile_share": None,
              "prefactor": 1.0, "special_first": True, "simplify": True, "keep": None, "connect": True},
    "solve": {"t0": 0.1, "end": 1e15, "factor": 1.2, "start": 1},
    "show": {"threshold": 0.02, "event": 0.01},
}


def deep_merge(base: dict, over: dict) -> dict:
    """``base`` with the values of ``over``; dictionaries are merged, everything else (lists too) replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(text: str | None = None) -> dict:
    """The defaults with the JSON document's values."""
    return deep_merge(DEFAULTS, json.loads(text) if text else {})


def parse_region(text: str, start: int, end: int) -> tuple[int, int]:
    """"i-j": that region; n > 0: to the n-th position at most; n < 0: the last -n positions; 0: all."""
    first, dash, last = text.partition("-")
    if dash and first:
        return int(first), int(last)
    n = int(text)
    if n > 0:
        return start, min(end, n)
    if n < 0 and -n < end:
        return end + n + 1, end
    return start, end
