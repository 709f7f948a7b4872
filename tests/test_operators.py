import hashlib

from pyspark.sql import functions as F

from driftwell.operators import compaction, cursors, health, merkle, repair

CHANGE = "key string, op string, hash string, data binary, version long, ms long, seq long"


def changes(spark, rows):
    df = spark.createDataFrame(rows, CHANGE)
    return df.withColumn("meta", F.struct(F.col("version").cast("decimal(20,0)").alias("version"))).drop("version")


def test_last_operation_wins_whatever_its_version(spark):
    rows = [
        ("a", "PUT", "1", b"1", 9, 1, 0), ("a", "DELETE", None, None, None, 1, 1),
        ("b", "DELETE", None, None, None, 1, 2), ("b", "PUT", "2", b"2", 1, 1, 10), ("b", "PUT", "3", b"3", 99, 1, 9),
        ("c", "PUT", "1", b"", 1, 2, 0), ("c", "PUT", "2", b"", 2, 3, 0), ("c", "PUT", "3", b"", 0, 4, 0),
    ]
    got = {r.key: (r.op, r.hash) for r in compaction.latest_wins(changes(spark, rows)).collect()}
    assert got == {"a": ("DELETE", None), "b": ("PUT", "2"), "c": ("PUT", "3")}
    assert {r.key: (r.op, r.hash) for r in compaction.latest_wins_window(changes(spark, rows)).collect()} == got


def test_half_of_ten_are_current(spark):
    pending = compaction.latest_wins(changes(spark, [(f"k{i}", "PUT", f"h{i}", b"x", 1, i, 0) for i in range(10)]))
    held = spark.createDataFrame([(f"k{i}", b"x", f"h{i}" if i < 5 else "old", None) for i in range(8)], compaction.EMPTY)
    left = compaction.not_current(pending, held)
    r = compaction.batch_result(pending, left).first()
    assert (r.total, r.skipped, r.submitted, r.deleted, r.errors, r.success) == (10, 5, 5, 0, 0, True)


def test_merging_twice_changes_nothing(spark):
    held = spark.createDataFrame([("a", b"1", "1", None), ("b", b"2", "2", None)], compaction.EMPTY)
    actions = compaction.latest_wins(changes(spark, [("a", "DELETE", None, None, None, 1, 0), ("c", "PUT", "3", b"3", 7, 2, 0), ("d", "DELETE", None, None, None, 3, 0)]))
    once = compaction.merge(held, actions)
    key = lambda df: sorted((r.object_id, r.content_hash) for r in df.collect())
    assert key(once) == [("b", "2"), ("c", "3")] == key(compaction.merge(once, actions))
    empty = actions.limit(0)
    assert key(compaction.merge(held, empty)) == [("a", "1"), ("b", "2")]
    assert compaction.batch_result(empty, empty).first().total == 0


def test_trimmed_empty_and_valid_cursors(spark):
    peers = spark.createDataFrame([("gap", "5-0"), ("ok", "20-0"), ("start", "0"), ("none", "0"), ("old", "7-1")], "peer_id string, stream_id string")
    log = spark.createDataFrame([(p, f"{m}-0", m, 0) for p in ("gap", "ok", "start") for m in (10, 20, 30)], "peer_id string, stream_id string, ms long, seq long")
    got = {r.peer_id: (r.status, r.read_from, r.lag_ms) for r in cursors.checked(peers, cursors.bounds(log, "peer_id")).collect()}
    assert got == {"gap": ("trimmed", "10-0", 25), "ok": ("events", "20-0", 10), "start": ("events", "0", None),
                   "none": ("empty", "0", None), "old": ("events", "7-1", None)}


def test_a_hundred_cursors_survive_a_flush(spark):
    table = spark.createDataFrame([(f"peer-{i:03}", f"{i}-{i}", i) for i in range(100)], "peer_id string, stream_id string, updated_at long")
    log = spark.createDataFrame([("peer-000", "9-9", 1, 1), ("peer-000", "3-3", 2, 2), ("peer-001", None, 3, 3), ("new", "1-1", 4, 4)],
                                "peer_id string, stream_id string, updated_at long, at long")
    got = {r.peer_id: r.stream_id for r in cursors.flush(table, log).collect()}
    assert len(got) == 100 and got["peer-000"] == "3-3" and "peer-001" not in got and got["new"] == "1-1" and got["peer-099"] == "99-99"


def leaves(spark, rows):
    return spark.createDataFrame([(p, hashlib.sha256(t.encode()).hexdigest()) for p, t in rows], "path string, hash string")


def test_interior_hash_by_hand(spark):
    rows = [("a.a1", "x"), ("b.b1", "y"), ("b.a2", "z")]
    root, level1, _ = merkle.tree(leaves(spark, rows), 2)
    sha = lambda b: hashlib.sha256(b).digest()
    a, b = sha(b"a1" + sha(b"x")), sha(b"a2" + sha(b"z") + b"b1" + sha(b"y"))
    assert {r.path: r.hash for r in level1.collect()} == {"a": a.hex(), "b": b.hex()}
    assert root.first().hash == sha(b"a" + a + b"b" + b).hex()


def test_drill_down_finds_what_leaves_differ(spark):
    local = leaves(spark, [("a.1", "x"), ("a.2", "x"), ("b.1", "x"), ("d.1", "x")])
    remote = leaves(spark, [("a.1", "x"), ("a.2", "y"), ("c.1", "x"), ("d.1", "x")])
    down = merkle.drill_down(merkle.tree(local, 2), merkle.tree(remote, 2))
    want = [("a.2", "fetch"), ("b.1", "delete"), ("c.1", "fetch")]
    assert sorted(tuple(r) for r in down.collect()) == want == sorted(tuple(r) for r in merkle.differing(local, remote).collect())
    none = local.limit(0)
    assert merkle.compare_roots(merkle.tree(local, 2)[0], merkle.tree(none, 2)[0]).first().verdict == "local_only"
    assert merkle.compare_roots(merkle.tree(none, 2)[0], merkle.tree(none, 2)[0]).first().verdict == "both_absent"
    assert merkle.compare_roots(merkle.tree(local, 2)[0], merkle.tree(local, 2)[0]).first().verdict == "in_sync"


def test_budget_takes_fetches_first(spark):
    d = spark.createDataFrame([("z", "fetch"), ("a", "delete"), ("b", "delete"), ("y", "fetch")], "key string, action string")
    assert [r.key for r in repair.budgeted(d, 3).collect()] == ["y", "z", "a"]
    per = d.withColumn("peer_id", F.lit("p1")).union(spark.createDataFrame([("q", "fetch"), ("r", "delete")], "key string, action string").withColumn("peer_id", F.lit("p2")))
    got = sorted((r.peer_id, r.key) for r in repair.budgeted_by_peer(per, 3).collect())
    assert got == [("p1", "a"), ("p1", "y"), ("p1", "z"), ("p2", "q")]


def test_a_missing_item_becomes_a_delete(spark):
    plan = spark.createDataFrame([("a", "fetch"), ("b", "fetch"), ("c", "delete")], "key string, action string")
    remote = spark.createDataFrame([("a", b"1", "1", None), ("c", b"1", "1", None)], compaction.EMPTY)
    assert {r.key: r.op for r in repair.fetched(plan, remote).collect()} == {"a": "PUT", "b": "DELETE", "c": "DELETE"}


def test_failure_runs_reset_on_success(spark):
    log = spark.createDataFrame([("p", 1, False), ("p", 2, True), ("p", 3, False), ("p", 4, False), ("q", 1, False), ("r", 1, True)], "peer_id string, at long, ok boolean")
    runs = health.circuit(health.failure_runs(log), F.lit(10), 2, 100)
    assert {r.peer_id: (r.failures, r.circuit) for r in runs.collect()} == {"p": (2, "Open"), "q": (1, "Closed"), "r": (0, "Closed")}
    later = health.circuit(health.failure_runs(log), F.lit(104), 2, 100)
    assert {r.circuit for r in later.collect()} == {"Closed"}
