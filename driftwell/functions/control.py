"""Backoff, objectives and circuit ratios, as columns and as plain functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Objectives

# Error kinds that a later attempt may cure.
RETRYABLE = ("Redis", "PeerConnection", "SyncEngine")


@dataclass(frozen=True)
class Retry:
    attempts: int | None
    initial_ms: int
    most_ms: int
    factor: float

    def delay_ms(self, attempt: int) -> float:
        if attempt <= 0:
            return float(self.initial_ms)
        try:
            return min(self.initial_ms * self.factor ** (attempt - 1), float(self.most_ms))
        except OverflowError:
            return float(self.most_ms)


# Attempts (None: without end), first and longest delay, factor.
RETRIES = {
    "default": Retry(10, 100, 30_000, 2.0),
    "startup": Retry(20, 500, 30_000, 1.5),
    "daemon": Retry(None, 1_000, 300_000, 2.0),
    "testing": Retry(3, 10, 100, 2.0),
}


def repair_backoff(failures: Column, base_ms: int, most_ms: int) -> Column:
    """base * 2^failures, at most the limit."""
    return F.least(F.lit(float(base_ms)) * F.pow(F.lit(2.0), failures), F.lit(float(most_ms)))


def retry_delay(attempt: Column, policy: Retry) -> Column:
    grown = F.lit(float(policy.initial_ms)) * F.pow(F.lit(policy.factor), attempt - 1)
    return F.when(attempt <= 0, float(policy.initial_ms)).otherwise(F.least(grown, F.lit(float(policy.most_ms))))


def violations(stream_read: Column, peer_operation: Column, batch_flush: Column, lag: Column, goal: Objectives) -> dict[str, Column]:
    """Strictly above the objective."""
    return {
        "stream_read_violation": stream_read > goal.stream_read_ms,
        "peer_op_violation": peer_operation > goal.peer_operation_ms,
        "batch_flush_violation": batch_flush > goal.batch_flush_ms,
        "lag_violation": lag > goal.lag_ms,
    }


def retryable(kind: Column) -> Column:
    return kind.isin(*RETRYABLE)


def failure_rate(failures: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(failures.cast("double"), total.cast("double")), F.lit(0.0))


def likely_open(rejections: Column, successes: Column) -> Column:
    return (rejections > 0) & (rejections > successes)


def since_success(now_ms: Column, last_success_ms: Column) -> Column:
    """Milliseconds since the last success; the largest long if there was none."""
    return F.coalesce(F.greatest(now_ms - last_success_ms, F.lit(0).cast("bigint")), F.lit(2**63 - 1))
