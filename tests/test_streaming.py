import pytest

from driftwell.config import ColdPath, HotPath, duration_ms
from driftwell.functions import control
from driftwell.operators import compaction
from driftwell.plans import registry
from driftwell.sources import fixtures, landing
from driftwell.streaming import adaptive, replication

from .conftest import SMALL


def test_a_restart_reads_only_what_is_new_and_replays_are_idempotent(spark):
    folder = landing.work_folder(spark, "t")
    feed = fixtures.feed(spark, SMALL)
    wide = feed.withColumnsRenamed({"at_ms": "ms"}).withColumn("seq", feed["event_id"])
    landing.land(wide.filter("event_id % 3 = 0"), f"{folder}/in", 2)
    store = replication.Store(spark, f"{folder}/store")
    run = lambda: replication.replicate(landing.tail(spark, f"{folder}/in", wide, 1), store, False).awaitTermination()
    run()
    assert store.latest() == 1
    run()
    assert store.latest() == 1  # nothing new
    landing.land(wide.filter("event_id % 3 != 0 AND event_id > 100"), f"{folder}/in", 1)
    run()
    assert store.latest() == 2
    before = sorted(map(tuple, store.snapshot(2).select("object_id", "content_hash").collect()))
    rows = spark.read.schema(wide.schema).parquet(f"{folder}/in").filter("event_id % 3 != 0 AND event_id > 100")
    store.apply(rows, 2, compressed=False)  # the batch runs again
    assert sorted(map(tuple, store.snapshot(2).select("object_id", "content_hash").collect())) == before
    done = store.all("results").agg({"total": "sum", "errors": "sum"}).first()
    assert done["sum(errors)"] == 0 and done["sum(total)"] > 0
    assert store.all("rejects").count() > 0


def test_the_store_is_empty_at_first(spark):
    store = replication.Store(spark, landing.work_folder(spark, "t"))
    assert store.latest() == -1 and store.snapshot(-1).columns == [c.split()[0] for c in compaction.EMPTY.split(", ")]


def test_decoding_query(spark):
    got = {r.key: (r.bytes, r.reject_reason) for r in registry.queries()["zstd_decode"](spark, SMALL).collect()}
    assert got == {"k0": (1_000_000, None), "k1": (0, None), "k2": (2, None), "k3": (25_600, None),
                   "b0": (None, "bad_frame"), "b1": (None, "bad_frame"), "b2": (None, "bad_frame"), "b3": (3, None)}


def test_batch_size_doubles_on_entering_catch_up_and_shrinks_on_empty_reads():
    s = HotPath(adaptive=True)
    assert adaptive.sizes(s, [60, 70, 0, 0, 50]) == [(200, True), (200, True), (180, False), (162, False), (324, True)]
    assert adaptive.sizes(s, [0] * 50)[-1] == (50, False)
    assert adaptive.sizes(s, [60, 0, 60, 0] * 10)[-2][0] == 1000
    assert {n for n, _ in adaptive.sizes(HotPath(), [60, 0, 60])} == {100}


def test_adaptive_query(spark):
    assert registry.queries()["adaptive_batch_sizes"](spark, SMALL).count() == 16


def test_flush_rule():
    s = HotPath()
    assert adaptive.should_flush(100, 0, 1, s) and adaptive.should_flush(1, 0, 50, s)
    assert not adaptive.should_flush(0, 0, 99, s) and not adaptive.should_flush(99, 0, 49, s) and not adaptive.should_flush(5, None, 99, s)


def test_token_bucket():
    now = [0.0]
    b = adaptive.TokenBucket(10, 3, lambda: now[0])
    assert [b.try_acquire() for _ in range(4)] == [True, True, True, False]
    assert b.wait_s() == pytest.approx(0.1)
    now[0] = 0.1
    assert b.try_acquire() and not b.try_acquire() and b.try_acquire(0)
    now[0] = 100
    assert b.try_acquire(3) and not b.try_acquire()
    assert all(adaptive.TokenBucket(None, 0).try_acquire() for _ in range(1000))


def test_circuit_opens_tries_and_closes():
    now = [0.0]
    c = adaptive.Circuit(2, 2, 10, lambda: now[0])

    def bad():
        raise OSError

    for _ in range(2):
        with pytest.raises(OSError):
            c.call(bad)
    with pytest.raises(adaptive.CircuitOpen):
        c.call(int)
    now[0] = 10
    assert c.call(int) == 0 and c.state == "half_open"
    assert c.call(int) == 0 and c.state == "closed"
    assert c.counts == {"calls": 4, "successes": 2, "failures": 2, "rejections": 1}


def test_backoff_and_durations():
    assert [ColdPath().backoff_ms(n) for n in (0, 1, 5, 6, 1000)] == [5_000, 10_000, 160_000, 300_000, 300_000]
    r = control.RETRIES["default"]
    assert [r.delay_ms(n) for n in (0, 1, 2, 9, 10, 10_000)] == [100, 100, 200, 25_600, 30_000, 30_000]
    assert [duration_ms(t) for t in ("5s", "250ms", "1m 30s", "2 hours", "soon", "", "5")] == [5000, 250, 90_000, 7_200_000, 5000, 5000, 5000]


def test_repair_waits_for_lagging_peers(spark):
    lags = spark.createDataFrame([("a", 5), ("b", None)], "peer_id string, lag_ms long")
    assert replication.caught_up(lags, 5) and not replication.caught_up(lags, 4)
