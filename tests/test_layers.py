"""Snapshots as a whole table and layers of operations over it, against a dictionary."""

import random

import pytest

from driftwell.operators import compaction
from driftwell.sources import landing
from driftwell.streaming import replication

LARGE = 4_000


def operations(spark, changes):
    rows = [(k, "DELETE" if v is None else "PUT", v, None if v is None else v.hex()[:16], None) for k, v in changes.items()]
    return spark.createDataFrame(rows, compaction.OPERATIONS).coalesce(2)


def held(store, version):
    return {r.object_id: bytes(r.content) for r in store.snapshot(version).collect()}


def changed(state, changes):
    return {k: v for k, v in (state | changes).items() if v is not None}


@pytest.fixture
def store(spark):
    store = replication.Store(spark, landing.work_folder(spark, "layers"))
    first = {f"k{i}": random.Random(i).randbytes(64) for i in range(LARGE)}
    store._write(operations(spark, first), -1, store.path("snapshot", 0))
    store.first = first
    return store


def draw(r):
    return {f"k{r.randrange(LARGE + 40)}": None if r.random() < 0.3 else r.randbytes(8) for _ in range(30)}


def test_batches_and_repairs_equal_a_dictionary(spark, store):
    r, states, kinds = random.Random(5), {0: store.first}, set()
    for version in range(1, 7):
        changes = draw(r)
        store._write(operations(spark, changes), version - 1, store.path("snapshot", version))
        states[version] = changed(states[version - 1], changes)
        if version % 2:
            for _ in range(2):
                changes = draw(r)
                store.commit_repair(operations(spark, changes), version)
                states[version] = changed(states[version], changes)
        kinds.add(landing.exists(spark, store._whole(store.path("snapshot", version))))
        assert held(store, version) == states[version]
    assert store.latest() == 6 and False in kinds
    assert held(store, 3) == states[3]
    # Written again after a failure, a batch gives the same.
    again = operations(spark, changed(states[6], {}))
    store._write(again, 5, store.path("snapshot", 6))
    assert held(store, 6).items() >= states[6].items()


def test_a_small_batch_writes_a_small_layer(spark, store):
    store._write(operations(spark, {"k1": b"new", "k2": None}), 0, store.path("snapshot", 1))
    whole, layer = (landing.size(spark, store.path("snapshot", v)) for v in (0, 1))
    assert layer < whole / 20
    plan = store.snapshot(1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and "SortMergeJoin" not in plan


def test_grown_layers_make_a_whole_table(spark, store, monkeypatch):
    monkeypatch.setattr(replication, "LAYERS", 3)
    for version in range(1, 9):
        store._write(operations(spark, {f"k{version}": b"x"}), version - 1, store.path("snapshot", version))
    whole = [v for v in range(9) if landing.exists(spark, store._whole(store.path("snapshot", v)))]
    assert whole == [0, 4, 8]
    monkeypatch.setattr(replication, "LAYER_SHARE", 0)
    store._write(operations(spark, {"a": b"x"}), 8, store.path("snapshot", 9))  # no layer yet
    store._write(operations(spark, {"b": b"x"}), 9, store.path("snapshot", 10))
    assert landing.exists(spark, store._whole(store.path("snapshot", 10))) and len(held(store, 10)) == LARGE + 2
    assert [p.rpartition("=")[2] for p in [store.layers(9)[0], *store.layers(9)[1]]] == ["8", "9"]


def test_pruning_keeps_what_the_oldest_version_rests_on(spark, store, monkeypatch):
    monkeypatch.setattr(replication, "LAYERS", 3)
    for version in range(1, 7):
        store._write(operations(spark, {f"k{version}": b"x"}), version - 1, store.path("snapshot", version))
    want = held(store, 6)
    store.prune(2)
    assert sorted(store.versions("snapshot")) == [4, 5, 6] and held(store, 6) == want


def test_overlaid_takes_the_last_operation(spark):
    base = spark.createDataFrame([("a", b"1", "h", None), ("b", b"2", "h", None)], compaction.EMPTY)
    layers = [operations(spark, x) for x in ({"a": None, "c": b"3"}, {"a": b"4", "c": None}, {})]
    got = {r.object_id: bytes(r.content) for r in compaction.overlaid(base, layers).collect()}
    assert got == {"a": b"4", "b": b"2"} and compaction.overlaid(base, []) is base
