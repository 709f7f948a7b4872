"""Bounds of a log, reads after a position, and the table of cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import positions


def bounds(entries: DataFrame, *by: str) -> DataFrame:
    """oldest_id, newest_id and length, for the whole log or per ``by``."""
    at = F.struct("ms", "seq")
    return entries.groupBy(*by).agg(
        F.min_by("stream_id", at).alias("oldest_id"), F.max_by("stream_id", at).alias("newest_id"),
        F.count("*").alias("length"),
    )


def read_after(entries: DataFrame, cursor: str, count: int | None = None) -> DataFrame:
    """Entries strictly after ``cursor`` in order, the first ``count`` if given.

    The bound is written on ``ms`` and ``seq`` so that it is pushed into the
    scan; with a count Spark keeps only that many rows of each partition.
    """
    head, _, tail = cursor.partition("-")
    whole = cursor.count("-") <= 1
    number = lambda s: int(s) if s.isascii() and s.isdigit() and int(s) < 2**64 else 0
    ms, seq = (number(head), number(tail)) if whole else (0, 0)
    rows = entries.filter(positions.after(F.col("ms"), F.col("seq"), ms, seq)).orderBy("ms", "seq")
    return rows.limit(count) if count is not None else rows


def resume(peers: DataFrame, cursors: DataFrame) -> DataFrame:
    """Each peer's position, the beginning where none is saved."""
    return peers.join(cursors, "peer_id", "left").withColumn(
        "stream_id", F.coalesce("stream_id", F.lit(positions.BEGINNING))
    )


def checked(resumed: DataFrame, limits: DataFrame) -> DataFrame:
    """Per peer: ``trimmed``, ``empty`` or ``events``, and the position to read from.

    The beginning is always valid, and so is any position in an empty log. A
    trimmed log is read from its oldest entry on, that entry included.
    """
    both = resumed.join(limits, "peer_id", "left")
    start = F.col("stream_id") == positions.BEGINNING
    gap = ~start & F.col("oldest_id").isNotNull() & (positions.compare(F.col("stream_id"), F.col("oldest_id")) < 0)
    status = F.when(gap, "trimmed").when(start & (F.coalesce("length", F.lit(0)) == 0), "empty").otherwise("events")
    return both.select(
        "peer_id", "stream_id", "oldest_id", "newest_id", F.coalesce("length", F.lit(0)).alias("length"),
        status.alias("status"), F.when(gap, F.col("oldest_id")).otherwise(F.col("stream_id")).alias("read_from"),
        gap.alias("inclusive"), positions.lag_ms(F.col("stream_id"), F.col("newest_id")).cast("long").alias("lag_ms"),
    )


def flush(table: DataFrame, changes: DataFrame) -> DataFrame:
    """The cursor table after a log of changes (peer_id, stream_id, updated_at, at).

    The last change of a peer wins, whatever the position; a NULL position
    deletes the peer's cursor.
    """
    last = changes.groupBy("peer_id").agg(F.max_by(F.struct("stream_id", "updated_at"), "at").alias("n"))
    merged = table.join(last, "peer_id", "full_outer")
    new = F.col("n").isNotNull()
    return merged.select(
        "peer_id",
        F.when(new, F.col("n.stream_id")).otherwise(F.col("stream_id")).alias("stream_id"),
        F.when(new, F.col("n.updated_at")).otherwise(F.col("updated_at")).alias("updated_at"),
    ).filter("stream_id IS NOT NULL")
