"""Named queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ColdPath, HotPath, Objectives
from ..functions import compression, control, parsing, positions
from ..operators import batching, compaction, cursors, health, merkle, repair
from ..sources import fixtures as fx
from ..sources import landing, peer
from ..streaming import adaptive, replication
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
START = "1704672000000-0"


def _as_long(df: DataFrame, *columns: str) -> DataFrame:
    """Unsigned numbers that fit a long, as long."""
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def parse_valid(spark: SparkSession, sf: str) -> DataFrame:
    rows = parsing.valid(fx.parsed(spark, sf))
    return _as_long(
        rows.select(
            "peer_id", "stream_id", "ms", "seq", "op", "key", "hash", F.col("data").cast("string").alias("data"),
            "meta.content_type", "meta.version", "meta.updated_at",
        ), "ms", "seq", "version",
    )


def _pending(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.latest_wins(fx.applicable(spark, sf))


def _surviving(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.not_current(_pending(spark, sf), fx.snapshot(spark, sf))


def latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    return _as_long(_pending(spark, sf).select("key", "op", "hash", "version", "ms", "seq"), "version", "ms", "seq")


def latest_wins_window(spark: SparkSession, sf: str) -> DataFrame:
    last = compaction.latest_wins_window(fx.applicable(spark, sf))
    return _as_long(last.select("key", "op", "hash", "meta.version", "ms", "seq"), "version", "ms", "seq")


def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    merged = compaction.merge(fx.snapshot(spark, sf), _surviving(spark, sf))
    return _as_long(merged.withColumn("content", F.col("content").cast("string")), "version")


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    resumed = cursors.resume(fx.peers(spark, sf).select("peer_id"), fx.cursors(spark, sf))
    return cursors.checked(resumed, cursors.bounds(fx.log(spark, sf), "peer_id"))


def cursor_flush(spark: SparkSession, sf: str) -> DataFrame:
    gone = (F.col("seq") % 5 == 0) & (F.col("peer_id") == "peer-2")
    changes = fx.log(spark, sf).select(
        "peer_id", F.when(~gone, F.col("stream_id")).alias("stream_id"), F.col("ms").alias("updated_at"), F.col("seq").alias("at")
    )
    return cursors.flush(spark.createDataFrame([], "peer_id string, stream_id string, updated_at long"), changes)


# Pairs of positions the comparison rules are stated with.
PAIRS = (
    ("1000-0", "2000-0"), ("1000-99", "1000-100"), ("0", "1000-0"), ("0", "0"), ("1000000005000-0", "1000000000000-0"),
    ("1000000000000-0", "invalid"), ("a-b-c", "5"), ("7-x", "7-0"), (" 5", "5.7"), ("", "-"), ("18446744073709551616-1", "3-1"),
)


def position_functions(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return spark.createDataFrame(PAIRS, "a string, b string").select(
        "a", "b", positions.position_ms(a).cast("long").alias("a_ms"), positions.position_seq(a).cast("long").alias("a_seq"),
        positions.timestamp_ms(a).cast("long").alias("a_time"), positions.compare(a, b).alias("compared"),
        positions.lag_ms(a, b).cast("long").alias("lag"),
    )


def trace_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = parsing.valid(fx.parsed(spark, sf)).filter("meta IS NOT NULL")
    parent = F.col("meta.trace_parent")
    return rows.select("stream_id", parsing.trace_id(parent).alias("trace_id"), parsing.parent_span_id(parent).alias("parent_span_id"))


def _tree(spark: SparkSession, sf: str, side: str | None = None) -> list[DataFrame]:
    return merkle.tree(fx.leaves(spark, sf, side), fx.DEPTH)


def _level(n: int, *columns: str) -> Query:
    return lambda spark, sf: _tree(spark, sf)[n].select(*columns)


def clean_branches(spark: SparkSession, sf: str) -> DataFrame:
    levels = _tree(spark, sf)
    return merkle.clean_branches(levels[3], levels[4].filter(F.col("segment").cast("long") % 97 == 0))


def divergent_branches(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.differing(_tree(spark, sf, "local")[2], _tree(spark, sf, "remote")[2])


def divergent_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves and nodes are stored, so texts are hashed and levels made once."""
    sides = (landing.stored(fx.leaves(spark, sf, side), side) for side in ("local", "remote"))
    return merkle.drill_down(*(merkle.stored_tree(leaves, fx.DEPTH, lambda t: landing.stored(t, "nodes")) for leaves in sides))


def divergent_by_leaf(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.differing(fx.leaves(spark, sf, "local"), fx.leaves(spark, sf, "remote")).withColumnRenamed("path", "key")


def local_only_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves below branches only the local side has, and below one named branch."""
    local, remote = _tree(spark, sf, "local"), _tree(spark, sf, "remote")
    only = local[3].join(remote[3], "path", "left_anti").select("path").union(local[3].filter("path LIKE 'de.%'").select("path"))
    return merkle.leaves_below(local[4], only, 3).select("path")


def set_differences(spark: SparkSession, sf: str) -> DataFrame:
    a, b = fx.leaves(spark, sf, "local"), fx.leaves(spark, sf, "remote")
    side = lambda x, y, name: x.exceptAll(y).select(F.lit(name).alias("side"), "path")
    return side(a, b, "local").union(side(b, a, "remote"))


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    return repair.budgeted(divergent_by_leaf(spark, sf), 60)


def repair_operations(spark: SparkSession, sf: str) -> DataFrame:
    remote = fx.leaves(spark, sf, "remote").select(
        F.col("path").alias("object_id"), F.col("hash").alias("content"), F.col("hash").alias("content_hash"),
        F.lit(None).cast("decimal(20,0)").alias("version"),
    )
    return repair.fetched(_plan(spark, sf), remote).select("key", "op", "hash")


def repair_by_peer(spark: SparkSession, sf: str) -> DataFrame:
    number = F.substring_index("key", ".", -1).cast("long") % 3
    diffs = divergent_by_leaf(spark, sf).withColumn("peer_id", F.concat(F.lit("peer-"), number.cast("string")))
    return repair.budgeted_by_peer(diffs, 40)


def repair_stats(spark: SparkSession, sf: str) -> DataFrame:
    done = repair_by_peer(spark, sf).withColumn("op", F.when(F.col("action") == "fetch", "PUT").otherwise("DELETE"))
    return repair.cycle_stats(fx.peers(spark, sf), done)


def _circuits(spark: SparkSession, sf: str) -> DataFrame:
    return health.circuit(health.failure_runs(fx.outcomes(spark, sf)), F.lit(0), threshold=1, reset_ms=30_000)


def peer_health(spark: SparkSession, sf: str) -> DataFrame:
    circuits = _circuits(spark, sf).select("peer_id", "circuit", "failures")
    return health.peer_health(fx.peers(spark, sf), circuits, _checked(spark, sf).select("peer_id", "lag_ms"))


def eligible_peers(spark: SparkSession, sf: str) -> DataFrame:
    waits = F.when(F.col("peer_id") == "peer-1", 2_000).when(F.col("peer_id") == "peer-0", 1_000)
    return repair.eligible(fx.peers(spark, sf).withColumn("backoff_until", waits), F.lit(1_500)).select("peer_id")


def idle_peers(spark: SparkSession, sf: str) -> DataFrame:
    """Clock and threshold count events, the fixture's only common clock."""
    log = fx.outcomes(spark, sf)
    last = log.groupBy("peer_id").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success"))
    now = log.agg(F.max("at")).first()[0]
    return repair.idle(fx.peers(spark, sf).join(last, "peer_id", "left"), F.lit(now), 2).select("peer_id")


def slo_violations(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    found = control.violations(v, v * 3, v * 2, v * 400, Objectives())
    names = ("stream_read", "peer_op", "batch_flush", "lag")
    counts = [F.count_if(c).alias(n) for n, c in zip(names, found.values(), strict=True)]
    return fx.outcomes(spark, sf).groupBy("kind").agg(*counts)


def backoff_schedule(spark: SparkSession, sf: str) -> DataFrame:
    n, cold = F.col("failures"), ColdPath()
    return spark.range(16).select(
        F.col("id").alias("failures"),
    ).select(
        "failures", control.repair_backoff(n, cold.backoff_base_ms, cold.backoff_max_ms).alias("repair_ms"),
        control.retry_delay(n, control.RETRIES["default"]).alias("retry_ms"),
        control.retry_delay(n, control.RETRIES["startup"]).alias("startup_ms"),
    )


def circuit_counters(spark: SparkSession, sf: str) -> DataFrame:
    circuit = F.when(F.col("kind").isin("view", "click"), "read").otherwise("write")
    result = F.when(~F.col("ok"), "failure").when(F.col("kind") == "signup", "rejected").otherwise("success")
    counts = health.counters(fx.outcomes(spark, sf).select(circuit.alias("circuit"), result.alias("result")))
    return counts.withColumn("failure_rate", control.failure_rate(F.col("failures"), F.col("calls"))).withColumn(
        "likely_open", control.likely_open(F.col("rejections"), F.col("successes"))
    )


def retryable_errors(spark: SparkSession, sf: str) -> DataFrame:
    kinds = [("Redis",), ("PeerConnection",), ("SyncEngine",), ("Config",), ("Decompression",), ("Shutdown",)]
    return spark.createDataFrame(kinds, "kind string").withColumn("retryable", control.retryable(F.col("kind")))


def metric_rollup(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return fx.outcomes(spark, sf).groupBy("peer_id", "kind").agg(
        F.count("*").alias("counter"), F.max_by("value", "at").alias("gauge"), F.min(v).alias("least"), F.max(v).alias("most"),
        F.count_if(v <= 10).alias("le_10"), F.count_if(v <= 100).alias("le_100"),
    )


def batch_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = parsing.valid(fx.parsed(spark, sf))
    batch = F.floor(F.col("ms") / HotPath().batch_timeout_ms).cast("long").alias("batch")
    return rows.groupBy("peer_id", batch).agg(F.count("*").alias("events"), F.count_distinct("key").alias("keys"))


def batch_closings(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of at most four keys and 50 ms; the clock runs 40,000 times as fast, so that batches hold several changes."""
    rows = parsing.valid(fx.parsed(spark, sf)).select(
        "peer_id", "op", "key", "hash", F.when(F.col("data").isNotNull(), F.lit(b"")).alias("data"), F.expr("ms div 40000").alias("ms"), "seq"
    )
    # Read several times: parsed and stored once, without the payloads.
    found = batching.batches(landing.stored(rows, "changes"), "peer_id", 4, HotPath().batch_timeout_ms)
    return _as_long(found, "first_ms", "first_seq", "last_ms", "last_seq")


def peer_items(spark: SparkSession, sf: str) -> DataFrame:
    """Values stored as JSON array, as plain text, and as an empty array."""
    e = fx.table(spark, sf, "events")
    last = e.groupBy(F.concat(F.lit("user."), F.col("user_id").cast("string")).alias("key")).agg(
        F.max("event_id").alias("n"), F.max_by("props", "event_id").alias("props")
    )
    value = (
        F.when(F.col("n") % 3 == 0, F.concat(F.lit("["), "props", F.lit("]")))
        .when(F.col("n") % 3 == 1, F.concat(F.lit("payload-"), F.col("n").cast("string")))
        .otherwise("[]")
    )
    stored = last.select(parsing.prefixed(F.lit("p:"), F.col("key")).alias("stored_key"), value.alias("value"))
    return peer.items(last.select("key"), stored, "p:")


def node_hashes(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _tree(spark, sf)[1]
    return nodes.select("path", F.lower(F.hex(parsing.node_hash(F.col("hash")))).alias("hash")).filter("hash IS NOT NULL")


def _streamed(spark: SparkSession, sf: str) -> replication.Store:
    """Land the feed in files and replicate it in two runs of several batches."""
    folder = landing.work_folder(spark, "stream")
    rows = fx.feed(spark, sf).withColumns({"ms": F.col("at_ms"), "seq": F.col("event_id")})
    wide = rows.drop("ms", "seq")
    store = replication.Store(spark, f"{folder}/store")
    middle = rows.agg(F.percentile_approx("ms", 0.6)).first()[0]
    for part in (rows.filter(F.col("ms") <= middle), rows.filter(F.col("ms") > middle)):
        landing.land(part, f"{folder}/landed", 1)
        replication.replicate(landing.tail(spark, f"{folder}/landed", wide, 1), store, compressed=False).awaitTermination()
    return store


def stream_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Versions are left out: a change whose content is already held is skipped and keeps the older one."""
    store = _streamed(spark, sf)
    return store.snapshot(store.latest()).select("object_id", "content_hash")


def stream_cursors(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf).cursor_table()


def zstd_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Compressed payloads, good and broken, through the parser."""
    import pyarrow as pa

    codec = pa.Codec("zstd", compression_level=3)
    plain = [b"x" * 1_000_000, b"", b"{}", bytes(range(256)) * 100]
    rows = [(f"{i}-0", "PUT", f"k{i}", codec.compress(p, asbytes=True), None, None) for i, p in enumerate(plain)]
    broken = [compression.MAGIC, compression.MAGIC + b"\0" * 20, codec.compress(plain[0], asbytes=True)[:-9], b"\x28\xb5\x2f"]
    rows += [(f"{i}-1", "PUT", f"b{i}", b, None, None) for i, b in enumerate(broken)]
    feed = spark.createDataFrame(rows, "stream_id string, op string, key string, data binary, hash string, meta string")
    out = parsing.parse(feed)
    return out.select("key", F.octet_length("data").alias("bytes"), parsing.content_hash(F.col("data")).alias("sha"), "reject_reason")


def adaptive_sizes(spark: SparkSession, sf: str) -> DataFrame:
    reads = [0, 60, 80, 10, 0, 0, 120, 0, 55, 200, 0, 0, 0, 0, 49, 50]
    found = adaptive.sizes(HotPath(adaptive=True), reads)
    return spark.createDataFrame([(i, n, s, c) for i, (n, (s, c)) in enumerate(zip(reads, found, strict=True))],
                                 "read int, events int, size int, catching_up boolean")


def string_items(spark: SparkSession, sf: str) -> DataFrame:
    """Values stored as arrays of a string, a number, null or nothing."""
    kind = F.col("user_id") % 5
    text = F.concat(F.lit('say \\"'), F.col("user_id").cast("string"), F.lit('\\" ü/'))
    value = (
        F.when(kind == 0, F.concat(F.lit('[ "'), text, F.lit('", 1]'))).when(kind == 1, F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit("]")))
        .when(kind == 2, "[null]").when(kind == 3, "[]").otherwise(F.concat(F.lit('["a", '), F.col("user_id").cast("string")))
    )
    users = fx.table(spark, sf, "events").select("user_id").distinct().select(F.col("user_id").cast("string").alias("key"), value.alias("value"))
    return peer.items(users.select("key"), users.select(parsing.prefixed(F.lit("s:"), F.col("key")).alias("stored_key"), "value"), "s:")


# Metadata documents; what each amounts to is stated in the SQL.
METADATA = (
    '{"content_type":"t","version":5,"updated_at":-7}', '{"content_type":"t","version":"5","updated_at":1}',
    '{"content_type":5,"version":5,"updated_at":1}', '{"content_type":"t","version":5,"updated_at":"1"}',
    '{"content_type":"t","version":-5,"updated_at":1}', '{"content_type":"t","version":5.0,"updated_at":1}',
    '{"content_type":"t","version":18446744073709551615,"updated_at":1,"trace_parent":null,"more":[1]}',
    '{"content_type":"t","version":18446744073709551616,"updated_at":1}', '{"content_type":"t","version":5,"updated_at":1,"trace_parent":3}',
    '{"content_type":"t","version":5,"updated_at":1,"trace_parent":"00-a-b-01"}', '{"content_type":"t","version":5}', "[]", "x",
    '{"content_type":"t","version":5,"updated_at":9223372036854775808}', '{"content_type":null,"version":5,"updated_at":1}',
)


def typed_metadata(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(METADATA)), "n int, t string").withColumn("m", parsing.meta(F.col("t")))
    return rows.select("n", F.col("m").isNotNull().alias("whole"), F.col("m.version").cast("string").alias("version"), "m.updated_at", "m.trace_parent")


# Zstd frames of the texts "", "hello hello hello" and {"a":1}, one cut short, one with a wrong body, and bytes that are none.
FRAMES = (
    "28b52ffd2000010000", "28b52ffd20116500003068656c6c6f200100314a11", "28b52ffd20073900007b2261223a317d",
    "28b52ffd20116500003068656c6c", "28b52ffdffffffffffffffff", "28b52f", "",
)


def compressed_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries with compressed payloads, parsed as any feed."""
    rows = [(f"{i}-0", "PUT", f"k{i}", bytes.fromhex(f), None, None) for i, f in enumerate(FRAMES)]
    feed = spark.createDataFrame(rows, "stream_id string, op string, key string, data binary, hash string, meta string")
    out = parsing.parse(feed, compressed=True)
    return out.select("key", F.octet_length("data").cast("long").alias("bytes"), parsing.content_hash(F.col("data")).alias("sha"), "reject_reason")


def batch_trace(spark: SparkSession, sf: str) -> DataFrame:
    reads = [60, 70, 0, 0, 50, 49, 55, 0]
    rows = [(i, n, s, c) for i, (n, (s, c)) in enumerate(zip(reads, adaptive.sizes(HotPath(adaptive=True), reads), strict=True))]
    return spark.createDataFrame(rows, "read int, events int, size int, catching_up boolean")


def observed_batches(spark: SparkSession, sf: str) -> DataFrame:
    """What the streamed batches have counted, together."""
    seen = _streamed(spark, sf).all("observed")
    return seen.agg(F.sum("events_read").alias("events_read"), F.sum("events_rejected").alias("events_rejected"), F.max("newest_ms").alias("newest_ms"))


def circuit_states(spark: SparkSession, sf: str) -> DataFrame:
    """The clock counts events; it stands one reset time after the least recent of the peers' last calls."""
    runs = health.failure_runs(fx.outcomes(spark, sf))
    now = runs.agg(F.min("last_at")).first()[0] + 1
    return health.circuit(runs, F.lit(now), threshold=1, reset_ms=1).select("peer_id", "failures", "circuit")


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    levels = _tree(spark, sf)
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def _hexed(df: DataFrame) -> DataFrame:
    return df.withColumn("hash", F.lower(F.hex("hash")))


def queries() -> dict[str, Query]:
    return {
        "cdc_parse_valid": parse_valid,
        "cdc_reject_reasons": lambda s, d: parsing.rejects(fx.parsed(s, d)).groupBy("reject_reason").agg(F.count("*").alias("n")),
        "cdc_rejected_entries": lambda s, d: parsing.rejects(fx.parsed(s, d)).select("peer_id", "stream_id", "reject_reason"),
        "cdc_latest_wins": latest_wins,
        "cdc_latest_wins_window": latest_wins_window,
        "cdc_currency_skip": lambda s, d: compaction.current(_pending(s, d), fx.snapshot(s, d)).select("key", "hash"),
        "cdc_surviving": lambda s, d: _surviving(s, d).select("key", "op", "hash"),
        "batch_result_counts": lambda s, d: compaction.batch_result(_pending(s, d), _surviving(s, d)),
        "apply_snapshot": snapshot,
        "stream_bounds": lambda s, d: cursors.bounds(fx.log(s, d), "peer_id"),
        "read_after_cursor": lambda s, d: cursors.read_after(fx.log(s, d), START).select("stream_id", "ms", "seq"),
        "first_n_after_cursor": lambda s, d: cursors.read_after(fx.log(s, d), START, 100).select("stream_id", "ms", "seq"),
        "trim_gap_by_peer": lambda s, d: _checked(s, d).select("peer_id", "stream_id", "oldest_id", "status", "read_from", F.coalesce("inclusive", F.lit(False)).alias("inclusive")),
        "cursor_resume": lambda s, d: cursors.resume(fx.peers(s, d).select("peer_id"), fx.cursors(s, d)),
        "cursor_flush": cursor_flush,
        "lag_by_peer": lambda s, d: _checked(s, d).select("peer_id", "lag_ms"),
        "position_functions": position_functions,
        "trace_context": trace_context,
        "merkle_root": _level(0, "hash"),
        "merkle_level1": _level(1, "path", "hash"),
        "merkle_level2": _level(2, "path", "hash"),
        "merkle_level3": _level(3, "path", "hash"),
        "merkle_children": lambda s, d: merkle.children(_tree(s, d)[2], "en"),
        "clean_branches": clean_branches,
        "root_compare": lambda s, d: merkle.compare_roots(_tree(s, d, "local")[0], _tree(s, d, "remote")[0]),
        "merkle_divergent_branches": divergent_branches,
        "divergent_keys": divergent_keys,
        "divergent_keys_by_leaf": divergent_by_leaf,
        "local_only_leaves": local_only_leaves,
        "key_set_differences": set_differences,
        "repair_plan_budgeted": _plan,
        "repair_plan_by_peer": repair_by_peer,
        "repair_operations": repair_operations,
        "repair_stats": repair_stats,
        "repair_report_only": lambda s, d: repair.report(divergent_by_leaf(s, d), ColdPath().peer_wins),
        "consecutive_failures": lambda s, d: health.failure_runs(fx.outcomes(s, d)),
        "peer_health": peer_health,
        "health_summary": lambda s, d: health.summary(peer_health(s, d)),
        "eligible_peers": eligible_peers,
        "idle_peers": idle_peers,
        "slo_violations": slo_violations,
        "backoff_schedule": backoff_schedule,
        "circuit_counters": circuit_counters,
        "retryable_errors": retryable_errors,
        "metric_rollup": metric_rollup,
        "batch_windows": batch_windows,
        "batch_closings": batch_closings,
        "peer_items": peer_items,
        "node_hashes": node_hashes,
        "stream_apply_equivalence": stream_apply,
        "stream_cursor_table": stream_cursors,
        "peer_string_items": string_items,
        "peer_root": lambda s, d: _hexed(peer.root(_nodes(s, d))),
        "peer_children": lambda s, d: _hexed(peer.children(_nodes(s, d))),
        "cdc_typed_metadata": typed_metadata,
        "cdc_compressed_entries": compressed_entries,
        "adaptive_batch_trace": batch_trace,
        "stream_observed_batches": observed_batches,
        "circuit_states": circuit_states,
        "zstd_decode": zstd_decode,
        "adaptive_batch_sizes": adaptive_sizes,
    }


def oracle_sql() -> dict[str, str]:
    return dict(sql.QUERIES)
