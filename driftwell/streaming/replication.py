"""The change log as a stream: a thin shell over the batch operators.

Each micro-batch is parsed, compacted and checked against the snapshot of the
batch before. What is left of it makes a new snapshot version, named after the
batch id: a layer of operations over the last whole table, or a new whole table
once the layers have grown. A batch that is run again after a failure reads the
same base and writes the same version, so applying is idempotent; offsets are
committed after it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import parsing
from ..operators import compaction, cursors
from ..sources import landing


#: Operations since the last whole table that make a new one due: by bytes, as a share of it, and by tables.
LAYER_SHARE, LAYERS = 0.125, 16


@dataclass
class Store:
    """Snapshot versions, rejects, batch results and cursors below one shared folder."""

    spark: SparkSession
    folder: str
    #: Counts observed while a batch was read, by batch, of this driver's run; ``all("observed")`` has every run's.
    metrics: dict[int, dict] = field(default_factory=dict)
    #: Snapshot versions that stay when a batch is complete; all if None.
    keep: int | None = None

    def path(self, kind: str, version: int) -> str:
        return f"{self.folder}/{kind}/v={version}"

    def snapshot(self, version: int) -> DataFrame:
        """The snapshot as of a batch, repaired if it was; before the first batch it is empty but for repairs."""
        whole, since = self.layers(version)
        base = self.spark.read.parquet(whole) if whole else self.spark.createDataFrame([], compaction.EMPTY)
        return compaction.overlaid(base, [self.spark.read.schema(compaction.OPERATIONS).parquet(path) for path in since])

    def layers(self, version: int) -> tuple[str | None, list[str]]:
        """The newest whole table up to a batch, and the operations since then, oldest first."""
        since: list[str] = []
        for v in range(version, -2, -1):
            paths = [self.path("snapshot", v)] * (v >= 0) + [self.path(f"repaired-{n}", v) for n in range(self.repairs(v))]
            for path in reversed(paths):
                if landing.exists(self.spark, self._whole(path)):
                    return path, since[::-1]
                since.append(path)
        return None, since[::-1]

    def _whole(self, path: str) -> str:
        """The mark of a table that holds all rows, not only operations."""
        return f"{self.folder}/whole/" + "-".join(path.split("/")[-2:])

    def _write(self, operations: DataFrame, version: int, path: str) -> None:
        """Write operations on a version as a layer, or the whole table once the layers have grown.

        A whole table is written when the operations since the last one amount
        to a share of it (``LAYER_SHARE``) or to ``LAYERS`` tables, so that the
        bytes written stay in proportion to the bytes that changed.
        """
        whole, since = self.layers(version)
        mark, grown = self._whole(path), sum(landing.size(self.spark, p) for p in since)
        if whole is None or len(since) >= LAYERS or grown > LAYER_SHARE * landing.size(self.spark, whole):
            rows = compaction.merge(self.snapshot(version), operations)
            landing.mark(self.spark, mark)
        else:
            kinds = [c.split() for c in compaction.OPERATIONS.split(", ")]
            rows = operations.select(*[F.col(c).cast(t).alias(c) for c, t in kinds])
            landing.remove(self.spark, mark)
        rows.write.mode("overwrite").parquet(path)

    def repairs(self, version: int) -> int:
        """How many repairs of a batch's snapshot are complete."""
        n = 0
        while landing.exists(self.spark, self.path(f"repaired-{n}", version) + "/_SUCCESS"):
            n += 1
        return n

    def commit_repair(self, operations: DataFrame, version: int) -> None:
        """Repairs stand beside the snapshot they were made for; the next batch starts from them."""
        self._write(operations, version, self.path(f"repaired-{self.repairs(version)}", version))

    def latest(self) -> int:
        """The newest complete version, from one listing; an incomplete one can only be the last."""
        for version in sorted(self.versions("snapshot"), reverse=True)[:2]:
            if landing.exists(self.spark, self.path("snapshot", version) + "/_SUCCESS"):
                return version
        return -1

    def versions(self, kind: str) -> list[int]:
        return [int(n[2:]) for n in landing.names(self.spark, f"{self.folder}/{kind}") if n.startswith("v=")]

    def all(self, kind: str) -> DataFrame:
        last = self.latest()
        return self.spark.read.parquet(*[self.path(kind, v) for v in sorted(self.versions(kind)) if 0 <= v <= last])

    def prune(self, keep: int) -> None:
        """Remove all but the newest ``keep`` snapshot versions, their repairs and what they rest on."""
        oldest = self.latest() - max(1, keep) + 1
        if oldest < 0:
            return
        whole, _ = self.layers(oldest)
        oldest = int(whole.rpartition("=")[2]) if whole else -1
        for kind in landing.names(self.spark, self.folder):
            if kind == "snapshot" or kind.startswith("repaired-"):
                for version in self.versions(kind):
                    if version < oldest:
                        landing.remove(self.spark, self.path(kind, version))

    def apply(self, feed: DataFrame, batch: int, compressed: bool = True) -> None:
        """Apply one micro-batch: rejects, counts, cursors and metrics beside the merged snapshot."""
        seen = Observation()
        parsed = parsing.parse(feed, compressed).observe(
            seen, F.count(F.lit(1)).alias("events_read"), F.count("reject_reason").alias("events_rejected"),
            F.max("ms").cast("long").alias("newest_ms"),
        )
        parsed = parsed.persist()
        pending = compaction.latest_wins(compaction.applicable(parsing.valid(parsed))).persist()
        # Few keys of the snapshot are pending: only theirs meet the operations.
        named = pending.select(F.col("key").alias("object_id"))
        held = self.snapshot(batch - 1).join(named, "object_id", "left_semi")
        surviving = compaction.not_current(pending, held).persist()
        out = [
            ("rejects", parsing.rejects(parsed).select("peer_id", "stream_id", "reject_reason")),
            ("results", compaction.batch_result(pending, surviving)),
            ("cursors", cursors.bounds(parsed, "peer_id").select("peer_id", F.col("newest_id").alias("stream_id"), F.lit(batch).alias("at"))),
        ]
        for kind, rows in out:
            rows.write.mode("overwrite").parquet(self.path(kind, batch))
        self.metrics[batch] = seen.get
        observed = self.spark.createDataFrame([(batch, *seen.get.values())], "batch long, events_read long, events_rejected long, newest_ms long")
        observed.write.mode("overwrite").parquet(self.path("observed", batch))
        # Last: its marker makes the batch complete.
        self._write(surviving, batch - 1, self.path("snapshot", batch))
        if self.keep is not None:
            self.prune(self.keep)
        surviving.unpersist()
        pending.unpersist()
        parsed.unpersist()

    def cursor_table(self) -> DataFrame:
        return self.all("cursors").groupBy("peer_id").agg(F.max_by("stream_id", "at").alias("stream_id"))


def replicate(
    feed: DataFrame, store: Store, compressed: bool = True, name: str | None = None,
    around: Callable[[DataFrame, int, Callable[[], None]], None] | None = None,
) -> StreamingQuery:
    """Run through everything landed so far, then stop; a later call goes on from there.

    ``around`` gets each batch's rows, its id and what applies it: limits and circuits stand there.
    """

    def batch_done(rows: DataFrame, batch: int) -> None:
        apply = lambda: store.apply(rows, batch, compressed)
        around(rows, batch, apply) if around else apply()

    writer = feed.writeStream.foreachBatch(batch_done).option("checkpointLocation", f"{store.folder}/checkpoint")
    return (writer.queryName(name) if name else writer).trigger(availableNow=True).start()


def dry_run(feed: DataFrame, folder: str, compressed: bool = True) -> StreamingQuery:
    """Parse and compact what has landed and store nothing: a sink that accepts all."""

    def check(rows: DataFrame, batch: int) -> None:
        pending = compaction.latest_wins(compaction.applicable(parsing.valid(parsing.parse(rows, compressed))))
        pending.write.format("noop").mode("overwrite").save()

    return feed.writeStream.foreachBatch(check).option("checkpointLocation", folder).trigger(availableNow=True).start()


def caught_up(lags: DataFrame, goal_ms: int) -> bool:
    """Whether no peer lags beyond the goal: repair waits until then."""
    return lags.filter(F.col("lag_ms") > goal_ms).isEmpty()
