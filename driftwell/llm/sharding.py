"""A uniform shuffle into shards of exact sizes.

A communication matrix says how many rows each input partition sends to each
shard. Its law, given the partitions' and shards' sizes, is the multivariate
hypergeometric one, so it is drawn from counts alone. Rows are then permuted
inside their partition, cut into the drawn counts, exchanged, and permuted again
inside their shard. No row's shard depends on another row's content, and every
shard gets exactly its share.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

SHARDS = 16
SEED = 20240229
#: Rows of a shard that are put in order together.
BLOCK = 50_000


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """Exact draw by inversion, walking outwards from the mode.

    Expected steps are about the standard deviation; sizes are not limited.
    """
    total = good + bad
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    log = math.lgamma
    at = math.exp(
        log(good + 1) - log(mode + 1) - log(good - mode + 1)
        + log(bad + 1) - log(drawn - mode + 1) - log(bad - drawn + mode + 1)
        - log(total + 1) + log(drawn + 1) + log(total - drawn + 1)
    )
    left = rng.random() - at
    up = down = mode
    p_up = p_down = at
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows by partition, columns by shard; shards' totals are at most one apart."""
    rng, total = random.Random(seed), sum(sizes)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    rng.shuffle(room)
    out = []
    for size in sizes:
        row, want, others = [], size, sum(room)
        for s in range(shards):
            others -= room[s]
            row.append(hypergeometric(rng, room[s], others, want))
            want -= row[-1]
        room = [r - x for r, x in zip(room, row, strict=True)]
        out.append(row)
    return out


def shuffle_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Null texts count as empty (size 1, CRC 0). Null ids and repeated rows are
    rows like any other; an empty table gives no rows; columns other than
    ``doc_id`` and ``text`` are not read. A shuffle has no groups: equal texts
    may fall into different shards. The matrix, partitions by shards, is the
    only thing made on the driver; texts are never exchanged.
    """
    spark = docs.sparkSession
    text = text_or_empty()
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("at"),
        ),
        "rows",
    )
    sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    parts = sorted(sizes)
    matrix = communication_matrix([sizes[p] for p in parts], shards, seed)
    ends = [(p, [sum(row[: s + 1]) for s in range(shards)]) for p, row in zip(parts, matrix, strict=True)]
    cuts = spark.createDataFrame(ends, "part int, ends array<long>")
    draw = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), "at")
    local = Window.partitionBy("part").orderBy(draw("leave"), "at")
    sent = rows.withColumn("rn", F.row_number().over(local)).join(cuts, "part")
    sent = sent.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rn"))).cast("int"))
    # Within a shard the order is by a second draw; blocks of that order are counted first.
    blocks = max(1, sum(sizes.values()) // (shards * BLOCK))
    sent = written(
        sent.withColumn("draw", draw("arrive"))
        .withColumn("block", F.floor((F.col("draw") / 2.0**64 + 0.5) * blocks))
        .drop("ends", "rn", "part"),
        "sent",
    )
    held = sent.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "block").orderBy("draw", "at")
    placed = sent.withColumn("slot", F.row_number().over(inside) - 1).join(base, ["shard", "block"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("slot") + F.col("base")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
