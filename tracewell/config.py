"""Parameters of the engine. A frozen object that functions take; environment settings may replace
a default, then a small settings mapping, then the value here."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    # Thresholds of segmentation and grading.
    jaccard_entry: float = 0.04
    pressure_start: int = 5_000
    pressure_peak: int = 20_000
    pressure_max: float = 0.30
    radius_weight: float = 2.0
    default_radius: float = 0.05
    confirm_chars: int = 5
    background_grade: str = "Far"
    tail_turns: int = 2
    # Retrieval.
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_hits: int = 5
    rrf_k: int = 60
    # Recall and merging.
    theta_max: float = 0.5
    recall_candidates: int = 15
    recall_neighbours: int = 5
    recall_final: int = 3
    s_keep: float = 0.5
    s_final: int = 3
    weight_fused: float = 0.8
    weight_plain: float = 0.4
    wiki_threshold: float = 0.70
    negative_cosine: float = 0.45
    dedup_similarity: float = 0.95
    hdl_chars: int = 150
    batch_chars: int = 12_000
    carryover_budget: int = 2_000
    session_ttl_s: int = 1_800
    idle_turns: int = 50

    def validate(self) -> Config:
        """This object, if its values make sense together."""
        if not 0 <= self.pressure_start < self.pressure_peak:
            raise ValueError("pressure must start before its peak")
        for name in ("jaccard_entry", "pressure_max", "theta_max", "s_keep", "wiki_threshold", "negative_cosine", "dedup_similarity"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be between 0 and 1")
        if min(self.bm25_k1, self.rrf_k, self.radius_weight) <= 0 or not 0 <= self.bm25_b <= 1:
            raise ValueError("retrieval parameters must be positive")
        return self


def load(settings: Mapping[str, object] | None = None, environ: Mapping[str, str] | None = None, prefix: str = "TRACEWELL_") -> Config:
    """Parameters from the environment, else from ``settings``, else the defaults; unknown names are ignored.

    A value that doesn't parse is skipped, so a bad setting never stops a job; a set of values that
    contradict each other raises.
    """
    environ = os.environ if environ is None else environ
    found: dict[str, object] = {}
    for f in fields(Config):
        raw = environ.get(prefix + f.name.upper(), (settings or {}).get(f.name))
        if raw is not None:
            try:
                found[f.name] = type(getattr(Config(), f.name))(raw)
            except (TypeError, ValueError):
                continue
    return replace(Config(), **found).validate()
