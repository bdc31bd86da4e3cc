"""Tunables of the engine, with their bounds; environment variables override defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    max_chars: int = 1200
    overlap_chars: int = 160
    max_unit_chars: int = 1800
    cut_ratio: float = 0.55
    repeated_pages: int = 3
    min_line: int = 15
    max_line: int = 220
    border_lines: int = 4
    top_k: int = 4
    window: int = 0
    candidate_multiplier: int = 8
    similarity_floor: float = 0.35
    min_rerank_score: float = 0.50
    max_context_chars: int = 10_000
    max_query_variants: int = 4
    max_results_per_source: int = 1
    max_content_similarity: float = 0.86
    window_same_section_only: bool = True
    shingle: int = 5
    min_overlap_words: int = 5
    max_overlap_words: int = 120
    lock_after: int = 5
    lock_minutes: int = 15
    session_hours: int = 8

    def __post_init__(self):
        for name, least in (("top_k", 1), ("candidate_multiplier", 2), ("max_context_chars", 1000), ("max_query_variants", 1), ("max_results_per_source", 1), ("window", 0)):
            if getattr(self, name) < least:
                object.__setattr__(self, name, least)

    @property
    def candidates(self) -> int:
        """How many neighbours each query variant asks for."""
        return max(self.top_k * self.candidate_multiplier, self.top_k + 12)

    @classmethod
    def from_env(cls, prefix: str = "FOLIUM_") -> EngineConfig:
        got = {}
        for f in fields(cls):
            raw = os.environ.get(f"{prefix}{f.name.upper()}")
            if raw is not None:
                kind = type(f.default)
                got[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        return cls(**got)
