"""Settings of a replication job, with the defaults used throughout."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_UNITS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
FALLBACK_MS = 5_000


def duration_ms(text: str) -> int:
    """Milliseconds of texts such as ``5s``, ``1m 30s`` or ``250ms``; 5 s if unreadable."""
    parts = re.findall(r"(\d+)\s*([a-z]+)", text.strip().lower())
    names = {"sec": "s", "secs": "s", "second": "s", "seconds": "s", "min": "m", "mins": "m", "minute": "m", "minutes": "m",
             "millis": "ms", "msec": "ms", "hour": "h", "hours": "h", "hr": "h", "day": "d", "days": "d"}
    units = [names.get(u, u) for _, u in parts]
    if not parts or any(u not in _UNITS for u in units) or re.sub(r"\d+\s*[a-z]+|\s", "", text.strip().lower()):
        return FALLBACK_MS
    return sum(int(n) * _UNITS[u] for (n, _), u in zip(parts, units, strict=True))


@dataclass(frozen=True)
class HotPath:
    max_batch_size: int = 100
    batch_timeout_ms: int = 50
    block_timeout: str = "5s"
    adaptive: bool = False
    min_batch_size: int = 50
    max_adaptive_batch: int = 1000
    #: The rate counts only where it is asked for.
    rate_limited: bool = False
    rate_per_second: int = 10_000
    burst: int = 1_000
    catch_up_events: int = 50


@dataclass(frozen=True)
class ColdPath:
    interval_ms: int = 60_000
    max_items: int = 1_000
    backoff_base_ms: int = 5_000
    backoff_max_ms: int = 300_000
    #: Delete local keys the peer does not have. Off unless asked for: it destroys data by design.
    peer_wins: bool = False

    def backoff_ms(self, failures: int) -> int:
        return min(self.backoff_base_ms * 2 ** min(failures, 62), self.backoff_max_ms)


@dataclass(frozen=True)
class Objectives:
    stream_read_ms: int = 100
    peer_operation_ms: int = 500
    batch_flush_ms: int = 200
    lag_ms: int = 30_000


@dataclass(frozen=True)
class Peer:
    node_id: str
    url: str = ""
    key_prefix: str = ""
    failure_threshold: int = 5
    reset_timeout_ms: int = 30_000

    def feed_key(self) -> str:
        return f"{self.key_prefix}cdc"

    def prefixed(self, key: str) -> str:
        return f"{self.key_prefix}{key}"


@dataclass(frozen=True)
class Settings:
    node_id: str = "local"
    hot: HotPath = field(default_factory=HotPath)
    cold: ColdPath = field(default_factory=ColdPath)
    objectives: Objectives = field(default_factory=Objectives)
    peers: tuple[Peer, ...] = ()
    ping_interval_ms: int = 30_000
    idle_ms: int = 60_000
    #: Times a failed run of the change log is started again, with growing pauses.
    restarts: int = 0
    #: Snapshot versions that are kept.
    versions: int = 10
