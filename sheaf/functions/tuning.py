"""Sizing rules and retry policy as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB, MIB = 1024, 1024 * 1024
# Defaults that change results.
ENTRY_CONCURRENCY, PUT_CONCURRENCY, GET_CONCURRENCY = 64, 16, 4
BLOCK_SIZE, MERGE_GAP, WINDOW_SIZE = 8 * MIB, 256 * KIB, 64 * MIB
ADAPTIVE_BASE, ADAPTIVE_WORKER, ADAPTIVE_FILE = 64 * MIB, 12 * MIB, 2 * KIB
ADAPTIVE_LARGE, ADAPTIVE_SLACK, ADAPTIVE_CAP = 512 * MIB, 384 * MIB, 512 * MIB
GET_STEP_MB, GET_MOST = 256, 8
PART_SIZE, PART_MOST, SINGLE_PUT_LIMIT = 16 * MIB, 10_000, 5 * 1024 * MIB
CATALOG_LIMIT, DELETE_BATCH, PROGRESS_STEP = 64 * MIB, 1000, 8 * MIB
THROTTLE_CODES = (
    "BandwidthLimitExceeded", "ProvisionedThroughputExceededException", "RequestLimitExceeded", "RequestThrottled",
    "RequestThrottledException", "SlowDown", "Throttling", "ThrottlingException", "TooManyRequestsException",
)
CONFLICT_CODES = ("ConditionalRequestConflict", "PreconditionFailed")


@dataclass(frozen=True)
class RetryPolicy:
    """Delays in milliseconds; ``jitter`` is ``full`` or ``none``."""

    attempts: int = 6
    base_ms: int = 250
    max_ms: int = 5_000
    slow_base_ms: int = 1_000
    slow_max_ms: int = 30_000
    jitter: str = "full"

    def __post_init__(self):
        if self.attempts < 1:
            raise ValueError("attempts must be at least 1")
        if min(self.base_ms, self.max_ms, self.slow_base_ms, self.slow_max_ms) < 0:
            raise ValueError("delays must not be negative")
        if self.base_ms > self.max_ms or self.slow_base_ms > self.slow_max_ms:
            raise ValueError("a base delay must not exceed its maximum")
        if self.jitter not in ("full", "none"):
            raise ValueError("jitter must be full or none")


def align_down(value: Column, step: int) -> Column:
    return value - value % step


def backoff_ms(attempt: Column, throttled: Column, policy: RetryPolicy = RetryPolicy()) -> Column:
    """Capped exponential delay before jitter."""
    factor = F.pow(F.lit(2.0), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(62)))
    base, most = F.when(throttled, policy.slow_base_ms).otherwise(policy.base_ms), F.when(throttled, policy.slow_max_ms).otherwise(policy.max_ms)
    return F.least(base * factor, most.cast("double")).cast("long")


def delay_ms(attempt: int, throttled: bool, policy: RetryPolicy, chance: float) -> float:
    """The same for one attempt, in plain Python, with jitter drawn from ``chance`` in [0, 1)."""
    base, most = (policy.slow_base_ms, policy.slow_max_ms) if throttled else (policy.base_ms, policy.max_ms)
    delay = min(base * 2 ** min(max(attempt - 1, 0), 62), most)
    return chance * (delay + 1) // 1 if policy.jitter == "full" else delay


def retry_delay_ms(attempt: Column, throttled: Column, policy: RetryPolicy = RetryPolicy()) -> Column:
    delay = backoff_ms(attempt, throttled, policy)
    return F.floor(F.rand() * (delay + 1)).cast("long") if policy.jitter == "full" else delay


def is_throttle(code: Column) -> Column:
    return F.coalesce(code.isin(*THROTTLE_CODES), F.lit(False))


def is_conflict(http_status: Column, code: Column) -> Column:
    return F.coalesce(http_status.isin(409, 412), F.lit(False)) | F.coalesce(code.isin(*CONFLICT_CODES), F.lit(False))


def failure_code(code: Column, kind: Column) -> Column:
    """The service's code, else the client's error kind with underscores."""
    return F.coalesce(code, F.replace(kind, F.lit(" "), F.lit("_")))


def is_retryable(kind: Column, io_kind: Column) -> Column:
    """Whether a producer's error may be tried again: service errors, and I/O that is not bad data."""
    return F.when(kind == "s3", True).when(kind == "io", ~F.coalesce(io_kind.isin("invalid_data", "invalid_input"), F.lit(False))).otherwise(False)


def error_message(code: Column, message: Column, display: Column) -> Column:
    return F.when(code.isNotNull() & message.isNotNull(), F.concat_ws(": ", code, message)).otherwise(F.coalesce(code, message, display))


def get_concurrency(memory_mb: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.floor(memory_mb / GET_STEP_MB), F.lit(GET_MOST))).cast("long")


def adaptive_window(memory_mb: Column, zip_bytes: Column, files: Column, workers: Column, gets: Column, block_size: int = BLOCK_SIZE) -> Column:
    """Bytes of the source window that memory leaves: subtract, bound by the archive, keep slack
    above the large threshold, cap, and never under one block (or the archive)."""
    reserved = F.lit(ADAPTIVE_BASE) + F.greatest(workers, F.lit(1)) * ADAPTIVE_WORKER + files * ADAPTIVE_FILE + F.greatest(gets, F.lit(1)) * block_size
    room = F.least(F.greatest(memory_mb * MIB - reserved, F.lit(0)), zip_bytes)
    room = F.least(F.when(room > ADAPTIVE_LARGE, room - ADAPTIVE_SLACK).otherwise(room), F.lit(ADAPTIVE_CAP))
    return F.greatest(room, F.least(F.lit(max(block_size, 1)), zip_bytes)).cast("long")


def worker_count(memory_mb: Column) -> Column:
    return F.greatest(F.lit(4), F.least(F.round(F.sqrt(memory_mb / 128.0) * 4), F.lit(16))).cast("long")


def put_count(workers: Column) -> Column:
    return F.greatest(F.lit(1), F.least(workers, F.lit(8))).cast("long")
