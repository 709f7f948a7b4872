"""From valid changes to one operation per key, and what a batch amounts to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def applicable(changes: DataFrame) -> DataFrame:
    """Without PUTs that lack data or hash: they are read but never applied."""
    return changes.filter("op = 'DELETE' OR (data IS NOT NULL AND hash IS NOT NULL)")


def latest_wins(changes: DataFrame) -> DataFrame:
    """The last operation of each key by position; versions are not compared.

    Aggregates inside each partition before the exchange, so a key with very
    many changes sends one row per partition. Filter ``applicable`` first: a
    change that is never applied leaves the earlier one in place.
    """
    last = F.max_by(F.struct("op", "hash", "data", F.col("meta.version").alias("version"), "ms", "seq"), F.struct("ms", "seq"))
    return changes.groupBy("key").agg(last.alias("last")).select("key", "last.*")


def latest_wins_window(changes: DataFrame) -> DataFrame:
    """The same by ranking; for callers that need all columns of the change."""
    order = Window.partitionBy("key").orderBy(F.col("ms").desc(), F.col("seq").desc())
    return changes.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def not_current(pending: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Pending operations without the PUTs whose hash the snapshot already has."""
    held = snapshot.select(F.col("object_id").alias("_key"), F.col("content_hash").alias("_hash"))
    same = (F.col("op") == "PUT") & (F.col("key") == F.col("_key")) & (F.col("hash") == F.col("_hash"))
    return pending.join(held, same, "left_anti")


def current(pending: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The PUTs the snapshot already has."""
    held = snapshot.select(F.col("object_id").alias("key"), F.col("content_hash").alias("hash"))
    return pending.filter("op = 'PUT'").join(held, ["key", "hash"], "left_semi")


def batch_result(pending: DataFrame, surviving: DataFrame, errors: int = 0) -> DataFrame:
    """total, skipped, submitted, deleted, errors and success of one batch."""
    all_ops = pending.select(F.lit("all").alias("of"))
    both = all_ops.union(surviving.select("op")).agg(
        F.count_if(F.col("of") == "all").alias("total"), F.count_if(F.col("of") == "PUT").alias("submitted"),
        F.count_if(F.col("of") == "DELETE").alias("deleted"),
    )
    return both.select(
        "total", (F.col("total") - F.col("submitted") - F.col("deleted")).alias("skipped"), "submitted", "deleted",
        F.lit(errors).cast("long").alias("errors"), F.lit(errors == 0).alias("success"),
    )


def merge(snapshot: DataFrame, actions: DataFrame) -> DataFrame:
    """Snapshot after upserts and deletes; one exchange of each side by key. Idempotent."""
    a = actions.select(
        F.col("key").alias("_key"), "op", F.col("data").alias("_data"), F.col("hash").alias("_hash"),
        F.col("version").alias("_version"),
    )
    both = snapshot.join(a, F.col("object_id") == F.col("_key"), "full_outer").filter("op IS NULL OR op = 'PUT'")
    put = F.col("op").isNotNull()
    pick = lambda new, old: F.when(put, F.col(new)).otherwise(F.col(old)).alias(old)
    return both.select(
        pick("_key", "object_id"), pick("_data", "content"), pick("_hash", "content_hash"), pick("_version", "version")
    )


def overlaid(snapshot: DataFrame, layers: list[DataFrame]) -> DataFrame:
    """Snapshot after several sets of operations, oldest first.

    Only the layers are grouped by key. The snapshot loses the keys they name,
    by a broadcast of these where Spark knows them to be few, and is not
    exchanged then.
    """
    if not layers:
        return snapshot
    every = [rows.select("key", F.struct("op", "data", "hash", "version").alias("change"), F.lit(n).alias("at")) for n, rows in enumerate(layers)]
    union = every[0]
    for rows in every[1:]:
        union = union.unionByName(rows)
    last = union.groupBy("key").agg(F.max_by("change", "at").alias("change")) if len(layers) > 1 else union
    named = union.select(F.col("key").alias("object_id"))
    put = last.filter("change.op = 'PUT'").select(
        F.col("key").alias("object_id"), F.col("change.data").alias("content"), F.col("change.hash").alias("content_hash"), "change.version"
    )
    return snapshot.join(named, "object_id", "left_anti").select(*put.columns).unionByName(put)


EMPTY = "object_id string, content binary, content_hash string, version decimal(20,0)"
OPERATIONS = "key string, op string, data binary, hash string, version decimal(20,0)"
