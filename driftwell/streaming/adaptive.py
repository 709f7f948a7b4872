"""Batch sizing, rate limit, circuit and drain rules, as plain objects for the driver."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from ..config import HotPath


@dataclass
class BatchSize:
    """Doubles on entering catch-up, shrinks by a tenth (ten at least) on every empty read."""

    settings: HotPath
    size: int = 0
    catching_up: bool = False

    def __post_init__(self) -> None:
        self.size = self.size or self.settings.max_batch_size

    def read(self, events: int) -> int:
        s = self.settings
        if events >= s.catch_up_events:
            if not self.catching_up and s.adaptive:
                self.size = min(self.size * 2, s.max_adaptive_batch)
            self.catching_up = True
        else:
            self.catching_up = False
            if not events and s.adaptive:
                self.size = max(self.size - max(self.size // 10, 10), s.min_batch_size)
        return self.size


def sizes(settings: HotPath, reads: Iterable[int]) -> list[tuple[int, bool]]:
    b = BatchSize(settings)
    return [(b.read(n), b.catching_up) for n in reads]


def should_flush(pending_keys: int, first_at_ms: float | None, now_ms: float, settings: HotPath) -> bool:
    """A batch closes when it is full, or some time after its first change."""
    timed_out = first_at_ms is not None and now_ms - first_at_ms >= settings.batch_timeout_ms
    return pending_keys > 0 and (pending_keys >= settings.max_batch_size or timed_out)


@dataclass
class TokenBucket:
    """``rate`` tokens a second, at most ``burst`` at once; no rate: no limit."""

    rate: float | None
    burst: int
    clock: Callable[[], float] = time.monotonic
    tokens: float = field(init=False)
    at: float = field(init=False)

    def __post_init__(self) -> None:
        self.tokens, self.at = float(self.burst), self.clock()

    def try_acquire(self, n: int = 1) -> bool:
        if self.rate is None:
            return True
        now = self.clock()
        self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
        if self.tokens < n:
            return False
        self.tokens -= n
        return True

    def acquire(self, n: int, sleep: Callable[[float], None] = time.sleep) -> float:
        """Take ``n`` tokens, in portions of a burst, and wait as long as that takes; the seconds waited."""
        waited = 0.0
        while n > 0 and self.rate is not None:
            portion = min(n, max(1, self.burst))
            if self.try_acquire(portion):
                n -= portion
                continue
            pause = max(self.wait_s(portion), 0.001)
            sleep(pause)
            waited += pause
        return waited

    def wait_s(self, n: int = 1) -> float:
        """Seconds until ``n`` tokens are there."""
        return 0.0 if self.rate is None or self.tokens >= n else (n - self.tokens) / self.rate


# Rate per second and burst.
BUCKETS = {"default": (1000, 100), "conservative": (100, 10), "aggressive": (10_000, 500), "unlimited": (None, 0)}
# Failures to open, successes to close, seconds until a trial.
CIRCUITS = {"default": (5, 2, 30.0), "aggressive": (3, 3, 60.0), "lenient": (10, 1, 15.0)}


class CircuitOpen(RuntimeError):
    """The call was not made."""


@dataclass
class Circuit:
    """Opens after consecutive failures, tries again after a while, closes after successes."""

    failures_to_open: int = 5
    successes_to_close: int = 2
    reset_s: float = 30.0
    clock: Callable[[], float] = time.monotonic
    state: str = "closed"
    run: int = 0
    opened: float = 0.0
    counts: dict[str, int] = field(default_factory=lambda: {"calls": 0, "successes": 0, "failures": 0, "rejections": 0})

    def call(self, action: Callable[[], object]) -> object:
        if self.state == "open" and self.clock() - self.opened < self.reset_s:
            self.counts["rejections"] += 1
            raise CircuitOpen
        if self.state == "open":
            self.state, self.run = "half_open", 0
        self.counts["calls"] += 1
        try:
            out = action()
        except Exception:
            self.counts["failures"] += 1
            self.run += 1
            if self.state == "half_open" or self.run >= self.failures_to_open:
                self.state, self.opened, self.run = "open", self.clock(), 0
            raise
        self.counts["successes"] += 1
        if self.state == "half_open":
            self.run += 1
            if self.run >= self.successes_to_close:
                self.state, self.run = "closed", 0
        else:
            self.run = 0
        return out
