"""Where batches of a change log close: when full, or some time after their first change."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stretches of one timeout each that are ranked together when pauses are looked for.
CHUNK = 4096


def _paused(changes: DataFrame, timeout_ms: int) -> DataFrame:
    """``changes`` with ``_run``: what lies in one run is not parted by a whole stretch without a change.

    Such a stretch is longer than the timeout, so a batch always closes there.
    Runs are found among the stretches that hold changes, chunk by chunk; only
    one row a chunk is ordered over the whole log.
    """
    at = changes.withColumn("_at", F.expr(f"ms div {timeout_ms}"))
    held = at.select("_of", "_at").distinct()
    before = held.select("_of", (F.col("_at") + 1).alias("_at"), F.lit(True).alias("_joined"))
    starts = held.join(before, ["_of", "_at"], "left").select(
        "_of", "_at", F.expr(f"_at div {CHUNK}").alias("_chunk"), F.when(F.col("_joined").isNull(), F.col("_at")).alias("_start")
    )
    chunks = starts.groupBy("_of", "_chunk").agg(F.max("_start").alias("_last"))
    earlier = F.max("_last").over(Window.partitionBy("_of").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.select("_of", "_chunk", earlier.alias("_earlier"))
    within = F.max("_start").over(Window.partitionBy("_of", "_chunk").orderBy("_at"))
    runs = starts.withColumn("_within", within).join(chunks, ["_of", "_chunk"])
    return at.join(runs.select("_of", "_at", F.coalesce("_within", "_earlier").alias("_run")), ["_of", "_at"])


def batches(changes: DataFrame, by: str, max_keys: int, timeout_ms: int) -> DataFrame:
    """One row per batch of each ``by``: first_ms, first_seq, last_ms, last_seq, events, keys, full.

    ``changes`` are valid ones (op, key, hash, data, ms, seq), taken in order of
    position. A batch closes with the change that brings its distinct keys to
    ``max_keys`` (``full``), else before the first change that comes
    ``timeout_ms`` or more after its first one. A PUT without data or hash
    starts the time but adds no key. An empty log has no batches; a null ``by``
    is a peer like any other; equal positions are ordered by key and operation.

    The rule goes from change to change, so a run without a pause is read by one
    task, in order, holding the keys of one batch; runs are spread over tasks.
    """
    if max_keys < 1 or timeout_ms < 1:
        raise ValueError("max_keys and timeout_ms must be positive")
    adds = F.expr("op = 'DELETE' OR (data IS NOT NULL AND hash IS NOT NULL)")
    rows = changes.select(F.struct(F.col(by).alias("of")).alias("_of"), "ms", "seq", "op", F.when(adds, F.col("key")).alias("_key"))
    order = ["_of", "_run", "ms", "seq", "_key", "op"]
    runs = _paused(rows, timeout_ms).repartition("_of", "_run").sortWithinPartitions(*order)
    number = "decimal(20,0)"
    flat = runs.select(F.col("_of.of").alias(by), F.col("_run").cast("long"), F.col("ms").cast(number), F.col("seq").cast(number), "_key")
    fields = f"first_ms {number}, first_seq {number}, last_ms {number}, last_seq {number}, events long, keys long, full boolean"
    kind = dict(flat.dtypes)[by]

    def closed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, run, keys, now = None, None, set(), None
        for part in parts:
            if schema is None:
                unsigned = pa.decimal128(20, 0)
                names = ("first_ms", "first_seq", "last_ms", "last_seq")
                schema = pa.schema([(by, part.schema.field(0).type), *((n, unsigned) for n in names), ("events", pa.int64()), ("keys", pa.int64()), ("full", pa.bool_())])
            done = []
            for of, run_of, ms, seq, key in zip(*(column.to_pylist() for column in part.columns), strict=True):
                if now is not None and ((of, run_of) != run or ms - now[1] >= timeout_ms):
                    done.append((*now, len(keys), False))
                    now = None
                if now is None:
                    run, keys, now = (of, run_of), set(), (of, ms, seq, ms, seq, 0)
                if key is not None:
                    keys.add(key)
                now = (*now[:3], ms, seq, now[5] + 1)
                if len(keys) >= max_keys:
                    done.append((*now, len(keys), True))
                    now = None
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip((*now, len(keys), False), schema, strict=True)], schema=schema)

    return flat.mapInArrow(closed, f"`{by}` {kind}, {fields}")
