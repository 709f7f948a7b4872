"""Repair plans: which differing keys to handle now, and what a cycle did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def budgeted(differences: DataFrame, items: int) -> DataFrame:
    """The first ``items`` keys, fetches before deletes, then by key.

    A sorted limit: every partition keeps ``items`` rows, so nothing is sorted
    as a whole.
    """
    return differences.orderBy(F.when(F.col("action") == "fetch", 0).otherwise(1), "key").limit(items)


def budgeted_by_peer(differences: DataFrame, items: int) -> DataFrame:
    """The same over several peers in turn; only fetches use up the common budget.

    Counts per peer and action decide how much each peer may do; rows are
    ranked inside a peer and action only.
    """
    n = differences.groupBy("peer_id").agg(
        F.count_if(F.col("action") == "fetch").alias("fetches"), F.count_if(F.col("action") == "delete").alias("deletes")
    )
    earlier = Window.orderBy("peer_id").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("fetches").over(earlier), F.lit(0))
    room = F.greatest(F.lit(items) - used, F.lit(0))
    may = n.select(
        "peer_id", F.least("fetches", room).alias("fetch"), F.greatest(room - F.col("fetches"), F.lit(0)).alias("delete")
    )
    rank = F.row_number().over(Window.partitionBy("peer_id", "action").orderBy("key"))
    # No share is larger than the budget, so every partition keeps that many rows of a peer and action before the exchange.
    told = differences.withColumn("_nth", rank).filter(F.col("_nth") <= items).join(may, "peer_id")
    allowed = F.when(F.col("action") == "fetch", F.col("fetch")).otherwise(F.col("delete"))
    return told.filter(F.col("_nth") <= allowed).select("peer_id", "key", "action")


def fetched(plan: DataFrame, remote: DataFrame) -> DataFrame:
    """Operations of a plan: a fetch the peer cannot answer becomes a delete.

    ``remote`` has ``object_id``, ``content``, ``content_hash``, ``version``.
    """
    both = plan.join(remote.withColumnRenamed("object_id", "key"), "key", "left")
    put = (F.col("action") == "fetch") & F.col("content").isNotNull()
    return both.select(
        "key", F.when(put, "PUT").otherwise("DELETE").alias("op"), F.when(put, F.col("content")).alias("data"),
        F.when(put, F.col("content_hash")).alias("hash"), F.when(put, F.col("version")).alias("version"),
    )


def report(differences: DataFrame, peer_wins: bool) -> DataFrame:
    """Without ``peer_wins`` local keys that the peer lacks are reported, not deleted."""
    return differences if peer_wins else differences.filter("action = 'fetch'")


def cycle_stats(peers: DataFrame, operations: DataFrame) -> DataFrame:
    """One row for a cycle; a peer is in sync if nothing was submitted for it."""
    per = operations.groupBy("peer_id").agg(
        F.count("*").alias("fetched"), F.count_if(F.col("op") == "PUT").alias("submitted"),
        F.count_if(F.col("op") == "DELETE").alias("deleted"),
    )
    none = lambda c: F.coalesce(c, F.lit(0))
    return peers.select("peer_id").join(per, "peer_id", "left").agg(
        F.count("*").alias("peers_checked"),
        F.count_if(none("submitted") == 0).alias("peers_in_sync"),
        F.coalesce(F.sum("fetched"), F.lit(0)).alias("items_fetched"),
        F.coalesce(F.sum("submitted"), F.lit(0)).alias("items_submitted"),
        F.coalesce(F.sum("deleted"), F.lit(0)).alias("items_deleted"),
        F.lit(0).cast("long").alias("errors"),
    )


def eligible(peers: DataFrame, now_ms: Column) -> DataFrame:
    """Connected peers that are not in backoff."""
    return peers.filter((F.col("state") == "Connected") & (F.coalesce("backoff_until", F.lit(0)) <= now_ms))


def idle(peers: DataFrame, now_ms: Column, threshold_ms: int) -> DataFrame:
    """Connected peers without a success for at least the threshold."""
    since = F.coalesce(now_ms - F.col("last_success"), F.lit(2**63 - 1))
    return peers.filter((F.col("state") == "Connected") & (since >= threshold_ms))
