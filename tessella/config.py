"""Reading configuration: defaults, and validation that falls back per field."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields
from typing import Any


@dataclass(frozen=True)
class Config:
    timeout_ms: float = 900000
    chunk_chars: int = 6000
    #: None: no cap.
    max_parts: int | None = 20
    max_input_chars: int | None = 400000
    cache_enabled: bool = True
    cache_ttl_hours: float = 168
    est_tokens_per_second: float = 0
    est_latency_per_call_ms: float = 0
    background_min_chars: int = 9000


#: Fixed limits that no configuration changes.
SHORT_TEXT, QUICK_CHARS, STRUCTURE_CHARS = 9000, 30000, 5000
CACHE_ENTRIES, HISTORY_ENTRIES, HISTORY_SHOWN, BATCH_ITEMS = 200, 20, 8, 10
PDF_BYTES, SAMPLED_PDF_BYTES = 30 * 1024 * 1024, 2 * 1024 * 1024
_POSITIVE = {"timeout_ms", "chunk_chars", "max_parts", "max_input_chars", "background_min_chars"}


def resolve(raw: Any) -> Config:
    """A valid configuration from any input; a field of the wrong type or range keeps its default."""
    given = raw if isinstance(raw, dict) else {}
    out = {}
    for f in fields(Config):
        v = given.get(f.name)
        if f.name == "cache_enabled":
            ok = isinstance(v, bool)
        else:
            ok = isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) and (v > 0 if f.name in _POSITIVE else v >= 0)
        out[f.name] = v if ok else f.default
    return Config(**out)
