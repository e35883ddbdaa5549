"""Settings of the alignment: defaults, then a JSON file, then environment variables."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields

from verdanta.functions import vocab as V


@dataclass(frozen=True)
class Config:
    weights: dict[str, float] = field(default_factory=lambda: dict(V.WEIGHTS))
    thresholds: dict[str, float] = field(default_factory=lambda: dict(V.THRESHOLDS))
    top_k: int = 100
    verify_chunk: int = 15


def load(path: str | None = None, env: dict[str, str] | None = None) -> Config:
    """The settings; a file or variable (VERDANTA_TOP_K, VERDANTA_THRESHOLDS='{"partial": 0.6}') may give some of them."""
    given = {}
    if path:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
    env = os.environ if env is None else env
    out = {}
    for f in fields(Config):
        value = given.get(f.name)
        if (text := env.get(f"VERDANTA_{f.name.upper()}")) is not None:
            value = json.loads(text)
        if value is not None:
            base = getattr(Config(), f.name)
            out[f.name] = base | value if isinstance(base, dict) else type(base)(value)
    unknown = set(given) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Config(**out)
