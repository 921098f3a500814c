"""Types, limits and errors of the pattern store."""

from __future__ import annotations

from dataclasses import dataclass

import math

PATTERN_SCHEMA = "id string, amplitude array<double>, phase array<double>, metadata map<string,string>"
STORED_SCHEMA = "corpus_id string, id string, pattern_len int, amplitude array<double>, phase array<double>, phase_center double, phase_bucket int, energy_total double, metadata map<string,string>"


@dataclass(frozen=True)
class Config:
    """Settings that change results; the rest is Spark's own configuration."""

    pattern_len: int = 1536
    buckets: int = 64
    bucket_rad: float = 0.2
    epsilon: float = 0.1
    top_k: int = 10
    top_k_max: int = 10_000
    longest: int = 65_536
    segment_rows: int = 500_000
    file_rows: int = 100_000
    compact_above: int = 3
    compact_fill: float = 0.35

    @property
    def width(self) -> float:
        return 2 * math.pi / self.buckets if self.buckets > 0 else self.bucket_rad

    @property
    def last_bucket(self) -> int:
        return math.ceil(2 * math.pi / self.width) - 1


CONFIG = Config()
STATES = ("ACTIVE", "READ_ONLY", "BROKEN", "DELETING")


class StoreError(Exception):
    """Base of the store's errors; code as a service would report it."""

    code = "error"


class InvalidPattern(StoreError):
    code = "invalid_pattern"


class DuplicatePattern(StoreError):
    code = "duplicate"


class CorpusNotReady(StoreError):
    """The corpus's state doesn't allow the operation."""

    code = "conflict"


class PatternNotFound(StoreError):
    code = "not_found"


class CorpusNotFound(StoreError):
    code = "not_found"


def clamp_k(k: int | None, config: Config = CONFIG) -> int:
    """A missing k is the default, a negative one 0, a large one the most allowed."""
    return config.top_k if k is None else max(0, min(k, config.top_k_max))
