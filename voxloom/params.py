"""Operator parameters and their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# Labels that appear in results.
UNKNOWN_SPEAKER = "SPEAKER_UNKNOWN"
FIRST_SPEAKER = "SPEAKER_00"
SECOND_SPEAKER = "SPEAKER_01"
PENDING, PROCESSING, COMPLETED, FAILED = "PENDING", "PROCESSING", "COMPLETED", "FAILED"

# Rows of one recording that share a block (see operators/blocks.py).
BLOCK_ROWS = 8192
# Width of the time bins that turn interval joins into equi-joins.
BIN_SECONDS = 60.0


@dataclass(frozen=True)
class Params:
    max_silence: float = 1.5
    max_clause_gap: float = 1.5
    vad_tolerance: float = 0.6
    overlap_floor: float = 0.05
    greeting_horizon: float = 12.0
    trigger_min_offset: int = 10
    min_diarise_seconds: float = 2.0
    min_snr_db: float = 15.0
    step_seconds: float = 0.3
    window_seconds: float = 1.2
    distance_threshold: float = 0.55
    max_speakers: int = 10
    max_attempts: int = 3
    stale_pending_seconds: int = 300
    stale_processing_seconds: int = 1800
    audio_retention_hours: int = 24
    result_retention_days: int = 30
    rate_limit: int = 30
    rate_period_seconds: int = 60
    max_upload_bytes: int = 100 * 1024 * 1024
    webhook_max_attempts: int = 5
    host_concurrency: int = 5
    stream_maxlen: int = 100_000
    claim_idle_ms: int = 900_000
    unbounded_duration: float = 1000.0
    profile: str = "full"
    domain_mode: str | None = None
    split_on_questions: bool = False
    custom_triggers: dict = field(default_factory=dict)


DEFAULTS = Params()
