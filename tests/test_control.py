"""The engine's rules for when to read, wait, try again and repair."""

import pytest
from pyspark.errors import StreamingQueryException

from driftwell.config import ColdPath, HotPath, Objectives, Peer, Settings
from driftwell.sources import landing
from driftwell.streaming import engine as E

from .test_engine import FEED, entry, items, snapshot


class Clock:
    """Time that only passes while somebody sleeps."""

    def __init__(self):
        self.ms, self.slept = 1_000_000, []

    def now(self):
        return self.ms

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.ms += round(1000 * seconds)


@pytest.fixture
def make(spark):
    def build(remotes, **settings):
        folder, like, clock = landing.work_folder(spark, "control"), spark.createDataFrame([], FEED), Clock()
        known = Settings(node_id=f"n{folder[-8:]}", peers=tuple(Peer(n) for n in remotes), **settings)
        engine = E.Engine(spark, known, f"{folder}/in", like, f"{folder}/store", remotes, now_ms=clock.now, sleep=clock.sleep)
        engine.start()
        return engine, clock

    return build


def land(spark, engine, rows, files=1):
    landing.land(spark.createDataFrame(rows, FEED), engine.landed, files)


def some(n, at=0):
    return [entry(at + i, "PUT", f"k{i}", b"v%d" % (at + i)) for i in range(1, n + 1)]


def test_nothing_is_read_while_writes_are_not_accepted(spark, make):
    engine, _ = make({"a": lambda: snapshot(spark, {})})
    land(spark, engine, some(3))
    engine.accepting_writes = False
    assert engine.catch_up() == -1 and engine.counts["paused"] == 1
    engine.accepting_writes = True
    assert engine.catch_up() == 0 and len(items(engine)) == 3


def test_a_rate_is_kept(spark, make):
    engine, clock = make({"a": lambda: snapshot(spark, {})}, hot=HotPath(rate_limited=True, rate_per_second=10, burst=5))
    land(spark, engine, some(25))
    engine.catch_up()
    assert sum(clock.slept) == pytest.approx(2.0, abs=0.1) and engine.counts["waited_ms"] == pytest.approx(2000, abs=100)
    free, clock = make({"a": lambda: snapshot(spark, {})})
    land(spark, free, some(25))
    free.catch_up()
    assert not clock.slept


def test_batch_size_follows_the_log_and_repair_waits(spark, make):
    held = {f"k{i}": b"v%d" % i for i in range(1, 61)}
    engine, clock = make({"a": lambda: snapshot(spark, held | {"new": b"1"})}, hot=HotPath(adaptive=True), cold=ColdPath(interval_ms=5_000))
    land(spark, engine, some(60))
    engine.catch_up()
    assert engine.batch.size == 200 and engine.catching_up()
    assert engine.run_repairs(2) == [None, None] and engine.counts["repairs_skipped"] == 2 and clock.slept == [5.0, 5.0]
    engine.catch_up()  # nothing new
    assert engine.batch.size == 180 and not engine.catching_up()
    done = engine.run_repairs(1)
    assert done[0].items_submitted == 1 and items(engine) == held | {"new": b"1"}


def test_repair_waits_for_landed_entries(spark, make):
    engine, _ = make({"a": lambda: snapshot(spark, {})}, objectives=Objectives(lag_ms=10))
    land(spark, engine, some(2))
    engine.catch_up()
    assert not engine.catching_up()
    land(spark, engine, some(2, at=500))
    assert engine.catching_up()


def test_failed_runs_start_again_and_the_circuit_opens(spark, make, monkeypatch):
    engine, clock = make({"a": lambda: snapshot(spark, {})}, restarts=2)
    land(spark, engine, some(2))
    apply, fails = engine.store.apply, [2]

    def broken(*args, **more):
        if fails[0]:
            fails[0] -= 1
            raise OSError("disk")
        apply(*args, **more)

    monkeypatch.setattr(engine.store, "apply", broken)
    assert engine.catch_up() == 0 and engine.counts["restarts"] == 2 and clock.slept == [1.0, 2.0] and len(items(engine)) == 2
    land(spark, engine, some(2, at=100))
    fails[0] = 100
    with pytest.raises(StreamingQueryException):
        engine.catch_up()
    assert engine.catch_up() == 0 and engine.writes.state == "open" and engine.counts["rejected"] >= 1
    before = fails[0]
    assert engine.catch_up() == 0 and fails[0] == before  # the call was not made
    fails[0] = 0
    clock.sleep(31)
    assert engine.catch_up() == 1 and engine.writes.state == "half_open"


def test_idle_peers_that_do_not_answer_are_disconnected(spark, make):
    def broken():
        raise OSError("no route")

    engine, clock = make({"a": lambda: snapshot(spark, {}), "b": broken})
    assert engine.ping_idle() == ["b"] and engine.peers["b"].last_error == "OSError: no route"
    assert engine.connected_count() == 1 and engine.ping_idle() == []
    clock.sleep(61)
    engine.remotes["a"] = broken
    assert engine.ping_idle() == ["a"] and engine.connected_count() == 0


def test_a_failing_repair_says_why(spark, make):
    def broken():
        raise OSError("no route")

    engine, _ = make({"a": broken})
    stats = engine.repair_cycle()
    assert stats.errors == 1 and stats.messages == {"a": "OSError: no route"} and engine.peers["a"].last_error == "OSError: no route"


def test_shutdown_drains_a_named_query(spark, make):
    engine, _ = make({"a": lambda: snapshot(spark, {})})
    land(spark, engine, some(4), files=4)
    feed = landing.tail(spark, engine.landed, engine.schema_like, 1)
    query = E.replication.replicate(feed, engine.store, True, engine.settings.node_id)
    assert query.name == engine.settings.node_id
    engine.shutdown()
    assert not query.isActive and engine.store.latest() == 3 and engine.state is E.State.STOPPED


def test_old_versions_go_and_counts_stay(spark, make):
    engine, _ = make({"a": lambda: snapshot(spark, {"r": b"1"})}, versions=2)
    for at in range(0, 40, 10):
        land(spark, engine, some(2, at=at))
        engine.catch_up()
    engine.repair_cycle()
    assert sorted(engine.store.versions("snapshot")) == [2, 3] and engine.store.latest() == 3
    assert items(engine).keys() == {"k1", "k2", "r"}
    assert engine.store.all("observed").agg({"events_read": "sum"}).first()[0] == 8
    assert {r.peer_id: r.stream_id for r in engine.store.cursor_table().collect()} == {"a": "32-0"}


def test_root_hashes_tell_equal_snapshots(spark):
    held = {f"k{i}": b"%d" % i for i in range(40)}
    one, two = snapshot(spark, held), snapshot(spark, dict(reversed(held.items())))
    other = snapshot(spark, held | {"k3": b"x"})
    root = lambda s, n=40: E.root_hash(s, n).first().hash
    assert root(one) == root(two) != root(other) and root(one, 10**6) == root(two, 10**6) != root(one)
    assert [E.tree_depth(n) for n in (0, 256**2, 256**2 + 1, 10**10)] == [1, 1, 2, 4]
