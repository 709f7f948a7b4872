import hashlib

import pytest

from driftwell.config import ColdPath, Peer, Settings
from driftwell.operators import compaction
from driftwell.sources import landing
from driftwell.streaming import engine as E
from driftwell.streaming import replication

FEED = "peer_id string, stream_id string, op string, key string, hash string, data binary, meta string, ms long, seq long"


def sha(data):
    return hashlib.sha256(data).hexdigest()


def entry(i, op, key, data=None, peer="a"):
    return (peer, f"{i}-0", op, key, sha(data) if data is not None else None, data, None, i, 0)


def snapshot(spark, items):
    return spark.createDataFrame([(k, v, sha(v), None) for k, v in items.items()], compaction.EMPTY)


@pytest.fixture
def make(spark):
    def build(remotes, **cold):
        folder, like = landing.work_folder(spark, "engine"), spark.createDataFrame([], FEED)
        settings = Settings(peers=tuple(Peer(n) for n in ("a", "b", "c")), cold=ColdPath(**cold))
        return E.Engine(spark, settings, f"{folder}/in", like, f"{folder}/store", remotes, now_ms=lambda: 1_000_000)

    return build


def items(engine):
    return {r.object_id: bytes(r.content) for r in engine.store.snapshot(engine.store.latest()).collect()}


def test_life_of_an_engine(spark, make):
    def broken():
        raise OSError("unreachable")

    held = {"x": b"1", "y": b"2", "new": b"3"}
    engine = make({"a": lambda: snapshot(spark, held), "b": broken})
    with pytest.raises(RuntimeError):
        engine.catch_up()
    engine.start()
    assert engine.is_running() and engine.connected_count() == 2
    rows = [entry(10, "PUT", "x", b"1"), entry(20, "PUT", "y", b"old"), entry(30, "PUT", "z", b"9"), entry(40, "MOVE", "z"), entry(50, "DEL", "gone")]
    landing.land(spark.createDataFrame(rows, FEED), engine.landed)
    assert engine.catch_up() == 0
    assert items(engine) == {"x": b"1", "y": b"old", "z": b"9"}
    assert engine.store.metrics[0] == {"events_read": 5, "events_rejected": 1, "newest_ms": 50}
    stats = engine.repair_cycle()
    assert (stats.peers_checked, stats.errors, stats.items_submitted, stats.items_deleted) == (2, 1, 2, 0)
    assert items(engine) == held | {"z": b"9"}
    assert engine.eligible() == ["a"] and engine.repair_cycle().peers_in_sync == 1
    landing.land(spark.createDataFrame([entry(60, "DEL", "x")], FEED), engine.landed)
    engine.catch_up()
    assert items(engine) == {"y": b"2", "new": b"3", "z": b"9"}
    h = engine.health_check().first()
    assert (h.peers, h.connected, h.ready, h.healthy, h.unhealthy_peers, h.max_lag_ms) == (3, 2, True, True, "c", 0)
    engine.shutdown()
    assert engine.state is E.State.STOPPED and engine.connected_count() == 0 and not engine.health_check().first().ready


def test_peer_wins_deletes_within_the_budget(spark, make):
    engine = make({"a": lambda: snapshot(spark, {"k1": b"1", "k2": b"2"})}, peer_wins=True, max_items=3)
    engine.start()
    landing.land(spark.createDataFrame([entry(i, "PUT", f"extra{i}", b"x") for i in range(5)], FEED), engine.landed)
    engine.catch_up()
    stats = engine.repair_cycle()
    assert (stats.items_fetched, stats.items_submitted, stats.items_deleted) == (2, 2, 1)
    assert len(items(engine)) == 6
    while engine.repair_cycle().items_deleted:
        pass
    assert items(engine) == {"k1": b"1", "k2": b"2"}


def test_repair_fills_an_empty_store(spark, make):
    engine = make({"a": lambda: snapshot(spark, {"k": b"1"})})
    engine.start()
    engine.repair_cycle()
    assert items(engine) == {"k": b"1"}


def test_a_local_delete_is_announced_and_applied(spark, make):
    engine = make({"a": lambda: snapshot(spark, {"k": b"1", "l": b"2"})})
    engine.start()
    engine.repair_cycle()
    out = landing.work_folder(spark, "out")
    engine.delete(spark.createDataFrame([("k",), ("k",), ("unknown",)], "key string"), out)
    assert items(engine) == {"l": b"2"}
    other = make({"a": lambda: snapshot(spark, {"k": b"1", "l": b"2"})})
    other.start()
    other.repair_cycle()
    landing.land(spark.read.parquet(out).select(*[c.split()[0] for c in FEED.split(", ")]), other.landed)
    other.catch_up()
    assert "k" not in items(other)


def test_no_peer_is_a_failure(make):
    engine = make({})
    with pytest.raises(RuntimeError):
        engine.start()
    assert engine.state is E.State.FAILED and engine.remove_peer("a") and not engine.remove_peer("a")


def test_a_failing_peer_opens_its_circuit(make):
    engine = make({})
    for _ in range(5):
        engine.record("a", False)
    assert engine.peers["a"].circuit(1_000_001) == "Open" and engine.peers["a"].circuit(1_030_000) == "Closed"
    assert engine.peers["a"].backoff_until_ms == 1_000_000 + 80_000
    engine.record("a", True)
    assert engine.peers["a"].failures == 0


def test_a_dry_run_stores_nothing(spark):
    folder = landing.work_folder(spark, "dry")
    landing.land(spark.createDataFrame([entry(1, "PUT", "k", b"x")], FEED), f"{folder}/in")
    feed = landing.tail(spark, f"{folder}/in", spark.createDataFrame([], FEED))
    replication.dry_run(feed, f"{folder}/c").awaitTermination()
    assert not landing.exists(spark, f"{folder}/snapshot")
