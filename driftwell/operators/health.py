"""Health of peers from their outcome log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failure_runs(outcomes: DataFrame) -> DataFrame:
    """Failures since the last success of each peer (peer_id, at, ok).

    Two aggregations instead of a window over the whole log: the last success
    per peer, then the failures after it.
    """
    last = outcomes.groupBy("peer_id").agg(
        F.max(F.when(F.col("ok"), F.col("at"))).alias("last_ok"), F.max("at").alias("last_at")
    )
    after = F.col("last_ok").isNull() | (F.col("at") > F.col("last_ok"))
    runs = outcomes.join(last, "peer_id").groupBy("peer_id", "last_ok", "last_at")
    return runs.agg(F.count_if(~F.col("ok") & after).alias("failures"))


def circuit(runs: DataFrame, now: Column, threshold: int, reset_ms: int) -> DataFrame:
    """``Open`` from the threshold on, until the reset time has passed since the last failure."""
    opened = (F.col("failures") >= threshold) & (now - F.col("last_at") < reset_ms)
    return runs.withColumn("circuit", F.when(opened, "Open").otherwise("Closed"))


def peer_health(peers: DataFrame, circuits: DataFrame, lags: DataFrame) -> DataFrame:
    """Per peer: state, circuit, failures, lag, and whether it is unhealthy."""
    both = peers.join(circuits, "peer_id", "left").join(lags, "peer_id", "left")
    open_ = F.coalesce(F.col("circuit"), F.lit("Closed")) == "Open"
    return both.select(
        "peer_id", "state", F.coalesce("circuit", F.lit("Closed")).alias("circuit"),
        F.coalesce("failures", F.lit(0)).alias("failures"), "lag_ms",
        (open_ | (F.col("state") != "Connected")).alias("unhealthy"),
    )


def summary(health: DataFrame, running: bool = True, accepting: bool = True) -> DataFrame:
    """One row over all peers."""
    connected = F.count_if(F.col("state") == "Connected")
    unhealthy = F.array_sort(F.collect_list(F.when(F.col("unhealthy"), F.col("peer_id"))))
    return health.agg(
        F.count("*").alias("peers"), connected.alias("connected"),
        F.count_if(F.col("circuit") == "Open").alias("circuits_open"), F.max("lag_ms").alias("max_lag_ms"),
        F.coalesce(F.bool_or(~F.col("unhealthy")), F.lit(False)).alias("any_healthy"),
        F.array_join(unhealthy, ",").alias("unhealthy_peers"),
        (F.lit(running) & (connected > 0)).alias("ready"),
        (F.lit(running and accepting) & (connected > 0)).alias("healthy"),
    )


def counters(outcomes: DataFrame) -> DataFrame:
    """Calls, successes, failures and rejections per circuit (``circuit``: read or write)."""
    return outcomes.groupBy("circuit").agg(
        F.count("*").alias("calls"), F.count_if(F.col("result") == "success").alias("successes"),
        F.count_if(F.col("result") == "failure").alias("failures"), F.count_if(F.col("result") == "rejected").alias("rejections"),
    )
