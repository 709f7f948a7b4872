"""Feeds, peers, cursors, snapshots and key trees derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import compaction
from ..operators import cursors as cursor_ops


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ms(ts: str = "ts"):
    """Epoch milliseconds, truncated; the session's zone must not matter."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} AS timestamp_ntz))")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw log entries of ``events``, some of them malformed, with peer_id, event_id, ms and seq.

    Errors become deletions. Every 97th entry lacks its operation, every 89th
    its key, every 79th its hash and every 73rd its data; every 83rd has a wrong
    hash, every 71st an unknown operation; every 7th has no metadata and every
    11th broken metadata.
    """
    e = table(spark, sf_dir, "events")
    every = lambda n: F.col("event_id") % n == 0
    ms = event_ms()
    meta = F.concat(
        F.lit('{"content_type":"application/json","version":'), F.col("event_id").cast("string"),
        F.lit(',"updated_at":'), ms.cast("string"),
        F.lit(',"trace_parent":"00-'), F.lpad(F.col("event_id").cast("string"), 32, "0"), F.lit("-"),
        F.lpad(F.col("user_id").cast("string"), 16, "0"), F.lit('-01"}'),
    )
    op = F.when(every(97), None).when(every(71), "PATCH").when(F.col("event_type") == "error", "del")
    hash_ = F.when(every(79), None).when(every(83), F.sha2(F.concat(F.lit("x"), "props"), 256)).otherwise(F.sha2("props", 256))
    return e.select(
        F.concat(F.lit("peer-"), (F.col("user_id") % 3).cast("string")).alias("peer_id"),
        "event_id",
        ms.alias("at_ms"),
        F.concat_ws("-", ms.cast("string"), F.col("event_id").cast("string")).alias("stream_id"),
        op.when(F.col("event_type") == "click", "put").otherwise("PUT").alias("op"),
        F.when(~every(89), F.concat(F.lit("user."), F.col("user_id").cast("string"))).alias("key"),
        hash_.alias("hash"),
        F.when(~every(73), F.col("props")).cast("binary").alias("data"),
        F.when(every(7), None).when(every(11), F.lit('{"version": 1.5}')).otherwise(meta).alias("meta"),
    )


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse(feed(spark, sf_dir), compressed=False)


def applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.applicable(parsing.valid(parsed(spark, sf_dir)))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store holds that has missed every tenth change."""
    last = compaction.latest_wins(applicable(spark, sf_dir).filter("event_id % 10 != 3"))
    return last.filter("op = 'PUT'").select(
        F.col("key").alias("object_id"), F.col("data").alias("content"), F.col("hash").alias("content_hash"), "version"
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the feed with plain ``ms`` and ``seq`` columns."""
    return feed(spark, sf_dir).select(
        "peer_id", "stream_id", F.col("at_ms").alias("ms"), F.col("event_id").alias("seq")
    )


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peers of the feed and one that has none, each in a state by its number."""
    n = F.substring_index("peer_id", "-", -1).cast("int")
    found = feed(spark, sf_dir).select("peer_id").distinct().union(spark.sql("SELECT 'peer-3' AS peer_id"))
    return found.select("peer_id", F.when(n == 2, "Backoff").otherwise("Connected").alias("state"))


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """peer-0 in the middle of its log, peer-1 before a trim, the others absent."""
    rows = log(spark, sf_dir)
    middle = cursor_ops.bounds(rows.filter("peer_id = 'peer-0' AND seq % 2 = 0 AND seq < 500"), "peer_id")
    return middle.select("peer_id", F.col("newest_id").alias("stream_id")).union(
        spark.sql("SELECT 'peer-1', '1000-5'")
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success or failure of each exchange with a peer; errors are failures."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("peer-"), (F.col("user_id") % 3).cast("string")).alias("peer_id"),
        F.col("event_id").alias("at"),
        (F.col("event_type") != "error").alias("ok"),
        F.col("event_type").alias("kind"),
        F.col("value"),
    )


#: Depth of the key tree: language, source, thousand, document.
DEPTH = 4


def leaves(spark: SparkSession, sf_dir: str, side: str | None = None) -> DataFrame:
    """Leaf nodes of ``documents``; a local side lacks some and a remote side lacks or changes others."""
    d = table(spark, sf_dir, "documents")
    id_ = F.col("doc_id").cast("string")
    path = F.concat_ws(".", "lang", "source", F.concat(F.lit("k"), F.floor(F.col("doc_id") / 1000).cast("string")), id_)
    text = F.coalesce("text", F.lit(""))
    if side == "local":
        d = d.filter("doc_id % 41 != 0")
    if side == "remote":
        d = d.filter("doc_id % 31 != 0")
        text = F.when(F.col("doc_id") % 37 == 0, F.concat(F.lit("changed "), text)).otherwise(text)
    return d.select(path.alias("path"), F.sha2(text, 256).alias("hash"))
