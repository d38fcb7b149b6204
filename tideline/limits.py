"""Bounds that belong to the data model: beyond them an input is an error, not a result."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PairLimits:
    """Cue pairs of any support, per reference and per query."""

    per_reference: int = 128
    total: int = 512


@dataclass(frozen=True)
class Limits:
    """Fixed values."""

    text_bytes: int = 1_048_576
    cues: int = 4096
    cue_bytes: int = 4096
    max_ms: int = 359_999_999
    references: int = 32
    references_most: int = 1000
    words: int = 32_768
    word_bytes: int = 128
    index_keys: int = 100_000
    namespace_bytes: int = 64
    value_bytes: int = 256
    name_bytes: int = 1024
    min_support: int = 3
    min_separation_ms: int = 8000
    max_spread_ms: int = 2000


LIMITS = Limits()
DEFAULT_PAIRS = PairLimits()
EPISODE_PAIRS = PairLimits(1024, 4096)
