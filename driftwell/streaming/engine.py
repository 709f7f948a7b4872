"""A replication job as one object: states, change log, repair cycles, health.

The hot path is ``replicate`` over everything peers have landed; the cold path
compares the local snapshot with each peer's, level by level of a hash tree
over the keys, and merges what a budget allows. Both write snapshot versions of
one ``Store``. Nothing row-like passes through the driver.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from typing import Protocol

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Peer, Settings
from ..functions import control, parsing
from ..operators import cursors, health, merkle, repair
from ..sources import landing
from . import adaptive, replication


class State(Enum):
    CREATED = 0
    CONNECTING = 1
    RUNNING = 2
    SHUTTING_DOWN = 3
    STOPPED = 4
    FAILED = 5


class RemoteSnapshot(Protocol):
    """What repair needs of a peer: its items (object_id, content, content_hash, version)."""

    def __call__(self) -> DataFrame: ...


@dataclass
class PeerStatus:
    peer: Peer
    state: str = "Disconnected"
    failures: int = 0
    last_success_ms: int | None = None
    last_failure_ms: int | None = None
    backoff_until_ms: int = 0
    last_error: str | None = None

    def circuit(self, now_ms: int) -> str:
        opened = self.failures >= self.peer.failure_threshold and self.last_failure_ms is not None
        return "Open" if opened and now_ms - self.last_failure_ms < self.peer.reset_timeout_ms else "Closed"


@dataclass
class RepairStats:
    peers_checked: int = 0
    peers_in_sync: int = 0
    items_fetched: int = 0
    items_submitted: int = 0
    items_deleted: int = 0
    errors: int = 0
    #: What went wrong, by peer.
    messages: dict[str, str] = field(default_factory=dict)


#: Children of a node of the key tree, and keys below its lowest one, about.
FAN_OUT = 256


def tree_depth(keys: int) -> int:
    """Levels of hash digits above the keys, so that no node gathers many more than FAN_OUT children."""
    depth = 1
    while FAN_OUT ** (depth + 1) < keys:
        depth += 1
    return depth


def key_leaves(snapshot: DataFrame, depth: int) -> DataFrame:
    """Leaves (path, hash) of a snapshot: ``depth`` pairs of digits of the key's hash, then the key without dots."""
    digits = F.sha2(F.encode("object_id", "utf-8"), 256)
    above = [F.substring(digits, 2 * i + 1, 2) for i in range(depth)]
    return snapshot.select(
        F.concat_ws(".", *above, F.hex(F.encode("object_id", "utf-8"))).alias("path"), F.col("content_hash").alias("hash")
    )


def root_hash(snapshot: DataFrame, keys: int) -> DataFrame:
    """The one row that tells whether two snapshots are equal; both sides take the depth for the same number of keys."""
    depth = tree_depth(keys)
    return merkle.tree(key_leaves(snapshot, depth), depth + 1)[0]


def differences(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(key, action) between two snapshots.

    Keys and hashes of both meet in one exchange: where both sides can be read,
    a tree would have to be made of the same leaves first.
    """
    sides = (side.select(F.col("object_id").alias("path"), F.col("content_hash").alias("hash")) for side in (local, remote))
    return merkle.differing(*sides).withColumnRenamed("path", "key")


@dataclass
class Engine:
    spark: SparkSession
    settings: Settings
    landed: str
    schema_like: DataFrame
    folder: str
    remotes: dict[str, RemoteSnapshot] = field(default_factory=dict)
    now_ms: Callable[[], int] = lambda: time.time_ns() // 1_000_000
    accepting_writes: bool = True
    state: State = State.CREATED
    peers: dict[str, PeerStatus] = field(default_factory=dict)
    sleep: Callable[[float], None] = time.sleep
    #: Events a landed file holds, about: turns a batch size into files.
    events_per_file: int = 1_000
    #: How often something was held back or tried again, of this driver's run.
    counts: Counter = field(default_factory=Counter)

    def __post_init__(self) -> None:
        hot, clock = self.settings.hot, lambda: self.now_ms() / 1000
        self.store = replication.Store(self.spark, self.folder, keep=self.settings.versions)
        self.batch = adaptive.BatchSize(hot)
        self.limit = adaptive.TokenBucket(hot.rate_per_second if hot.rate_limited else None, hot.burst, clock)
        self.writes = adaptive.Circuit(clock=clock)
        for peer in self.settings.peers:
            self.add_peer(peer)

    # ---- peers

    def add_peer(self, peer: Peer) -> None:
        self.peers[peer.node_id] = PeerStatus(peer)

    def remove_peer(self, node_id: str) -> bool:
        return self.peers.pop(node_id, None) is not None

    def connect_all(self) -> None:
        """Peers whose snapshot can be named are connected."""
        for name, status in self.peers.items():
            status.state = "Connected" if name in self.remotes else "Disconnected"

    def connected_count(self) -> int:
        return sum(s.state == "Connected" for s in self.peers.values())

    def record(self, node_id: str, ok: bool, error: str | None = None) -> None:
        s, now = self.peers[node_id], self.now_ms()
        s.last_error = error
        if ok:
            s.failures, s.last_success_ms, s.backoff_until_ms = 0, now, 0
        else:
            s.backoff_until_ms = now + self.settings.cold.backoff_ms(s.failures)
            s.failures, s.last_failure_ms = s.failures + 1, now

    # ---- lifecycle

    def start(self) -> None:
        if self.state not in (State.CREATED, State.STOPPED):
            raise RuntimeError(f"cannot start while {self.state.name}")
        self.state = State.CONNECTING
        self.connect_all()
        if self.peers and not self.connected_count():
            self.state = State.FAILED
            raise RuntimeError("no peer can be reached")
        self.state = State.RUNNING

    def shutdown(self) -> None:
        """Streams stop after the batch they are in."""
        self.state = State.SHUTTING_DOWN
        for query in self.spark.streams.active:
            if query.name == self.settings.node_id:
                query.processAllAvailable()
                query.stop()
        for status in self.peers.values():
            status.state = "Disconnected"
        self.state = State.STOPPED

    def is_running(self) -> bool:
        return self.state is State.RUNNING

    # ---- hot path

    def catch_up(self, files_per_trigger: int | None = None, compressed: bool = True) -> int:
        """Apply everything landed so far; the snapshot version reached.

        Reads nothing while writes are not accepted or their circuit is open. A
        failed run starts again after a pause, as often as the settings allow;
        its batch is applied whole again.
        """
        if not self.is_running():
            raise RuntimeError(f"not running but {self.state.name}")
        if not self.accepting_writes:
            self.counts["paused"] += 1
            return self.store.latest()
        files = files_per_trigger or (max(1, self.batch.size // self.events_per_file) if self.settings.hot.adaptive else None)
        for attempt in range(self.settings.restarts + 1):
            before = self.store.latest()
            feed = landing.tail(self.spark, self.landed, self.schema_like, files)
            try:
                replication.replicate(feed, self.store, compressed, self.settings.node_id, self._around).awaitTermination()
                break
            except StreamingQueryException:
                if self.writes.state == "open":
                    self.counts["rejected"] += 1
                    return self.store.latest()
                if attempt == self.settings.restarts:
                    raise
                self.counts["restarts"] += 1
                self.sleep(control.RETRIES["daemon"].delay_ms(attempt + 1) / 1000)
        if self.store.latest() == before:
            self.batch.read(0)
        return self.store.latest()

    def _around(self, rows: DataFrame, batch: int, apply: Callable[[], None]) -> None:
        """Rate limit before a batch, the circuit of writes around it, the batch size after it."""
        if self.settings.hot.rate_limited:
            self.counts["waited_ms"] += round(1000 * self.limit.acquire(rows.count(), self.sleep))
        self.writes.call(apply)
        self.batch.read(self.store.metrics[batch]["events_read"])

    def delete(self, keys: DataFrame, folder: str) -> None:
        """Delete local keys and announce it: entries for peers are landed in ``folder``.

        Replicated deletes never go this way, or they would travel in circles.
        """
        version = self.store.latest()
        held = self.store.snapshot(version)
        gone = held.join(keys.select(F.col("key").alias("object_id")).distinct(), "object_id", "left_semi").select("object_id")
        entries = gone.select(
            F.lit(self.settings.node_id).alias("peer_id"), F.lit(self.now_ms()).alias("ms"),
            F.monotonically_increasing_id().alias("seq"), F.lit("DEL").alias("op"), F.col("object_id").alias("key"),
        )
        none = {c: F.lit(None).cast(t) for c, t in (("hash", "string"), ("data", "binary"), ("meta", "string"))}
        landing.land(entries.withColumn("stream_id", F.concat_ws("-", "ms", "seq")).withColumns(none), folder)
        none = {c: F.lit(None).cast(t) for c, t in (("data", "binary"), ("hash", "string"), ("version", "decimal(20,0)"))}
        self.store.commit_repair(gone.select(F.col("object_id").alias("key"), F.lit("DELETE").alias("op")).withColumns(none), version)

    # ---- cold path

    def eligible(self) -> list[str]:
        now = self.now_ms()
        return sorted(n for n, s in self.peers.items() if s.state == "Connected" and s.backoff_until_ms <= now)

    def catching_up(self) -> bool:
        """Whether the last batch was large, or a peer's landed entries are older than the objective."""
        return self.batch.catching_up or not replication.caught_up(self.lags(), self.settings.objectives.lag_ms)

    def run_repairs(self, cycles: int) -> list[RepairStats | None]:
        """Repair cycles at the settings' interval while the engine runs; None where the change log had to come first.

        A cycle that takes longer than the interval puts off the next one; missed ones are not made up for.
        """
        out: list[RepairStats | None] = []
        for _ in range(cycles):
            if not self.is_running():
                break
            began = self.now_ms()
            held = self.catching_up()
            self.counts["repairs_skipped"] += held
            out.append(None if held else self.repair_cycle())
            spent, every = self.now_ms() - began, self.settings.cold.interval_ms
            self.sleep((every - spent % every) / 1000)
        return out

    def ping_idle(self) -> list[str]:
        """Ask peers that were not heard of for a while; those that fail are disconnected."""
        now, gone = self.now_ms(), []
        for name, s in self.peers.items():
            if s.state != "Connected" or s.last_success_ms is not None and now - s.last_success_ms < self.settings.idle_ms:
                continue
            try:
                self.remotes[name]().limit(1).count()
                self.record(name, True)
            except Exception as e:  # whatever a peer's reader raises
                self.record(name, False, f"{type(e).__name__}: {e}"[:500])
                s.state = "Disconnected"
                gone.append(name)
        return gone

    def repair_cycle(self) -> RepairStats:
        """Compare with each eligible peer in turn and merge what the budget allows.

        The tree is taken anew for every peer. Local keys a peer lacks are only
        deleted with ``peer_wins``. A failing read counts as an error and sends
        the peer into backoff; it never deletes.
        """
        stats, room = RepairStats(), self.settings.cold.max_items
        for name in self.eligible():
            stats.peers_checked += 1
            try:
                n = self._repair_with(name, room)
            except Exception as e:  # whatever a peer's reader raises keeps only that peer out
                stats.errors += 1
                stats.messages[name] = f"{type(e).__name__}: {e}"[:500]
                self.record(name, False, stats.messages[name])
                continue
            self.record(name, True)
            stats.peers_in_sync += not n["PUT"]
            stats.items_fetched += n["fetch"]
            stats.items_submitted += n["PUT"]
            stats.items_deleted += n["DELETE"]
            room = max(0, room - n["fetch"])
        return stats

    def _repair_with(self, name: str, room: int) -> dict[str, int]:
        version, remote = self.store.latest(), self.remotes[name]()
        local = self.store.snapshot(version)
        found = repair.report(differences(local, remote), self.settings.cold.peer_wins)
        plan = repair.budgeted(found, room).persist()
        operations = repair.fetched(plan, remote)
        if not self.settings.cold.peer_wins:
            operations = operations.filter("op = 'PUT'")
        operations = operations.persist()
        n = {"fetch": plan.filter("action = 'fetch'").count(), "PUT": 0, "DELETE": 0}
        n |= {r["op"]: r["count"] for r in operations.groupBy("op").count().collect()}
        if n["PUT"] or n["DELETE"]:
            self.store.commit_repair(operations, version)
        operations.unpersist()
        plan.unpersist()
        return n

    # ---- health

    def health_check(self) -> DataFrame:
        """One row: peers, circuits, lag, readiness."""
        now = self.now_ms()
        rows = [(n, s.state, s.circuit(now), s.failures) for n, s in self.peers.items()]
        peers = self.spark.createDataFrame(rows, "peer_id string, state string, circuit string, failures long")
        circuits = peers.select("peer_id", "circuit", "failures")
        return health.summary(
            health.peer_health(peers.select("peer_id", "state"), circuits, self.lags()), self.is_running(), self.accepting_writes
        )

    def lags(self) -> DataFrame:
        """Milliseconds each peer's cursor is behind what has landed."""
        if self.store.latest() < 0:
            return self.spark.createDataFrame([], "peer_id string, lag_ms long")
        log = parsing.parse(self.spark.read.schema(self.schema_like.schema).parquet(self.landed), compressed=False)
        seen = self.store.cursor_table()
        return cursors.checked(cursors.resume(log.select("peer_id").distinct(), seen), cursors.bounds(log, "peer_id")).select("peer_id", "lag_ms")
