"""Near copies by exact Jaccard similarity of word shingles.

Two texts are near copies if their sets of five-word shingles have a Jaccard
similarity of 0.8 or more; near copies of near copies belong together. All such
pairs are found by prefix filtering: under one order of all shingles, sets that
are similar enough share a shingle among the first fifth of each. The order
takes shingles that are frequent in a sample last, so that common passages
rarely bring texts together; any order gives the same pairs. Sizes and
positions rule out most candidates, and the rest are compared set by set.

Equal sets are one node. Large groups are first linked by way of a few centres
per shingle; only candidates that are still apart then meet pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, packed_row, written
from .simhash import SEED, components, split_words

SHINGLE = 5
#: Rounds in which every shingle's texts are compared with one centre.
CENTRES = 2
#: Frequent shingles that are ordered last, and one in how many rows is sampled for them; speed only.
FREQUENT, SAMPLED = 20_000, 16


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes (signed) of the text's shingles; a shorter text is one shingle."""
    words = split_words(text)
    n = max(1, len(words) - SHINGLE + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(n)], np.uint64).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of 0.8 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * both >= 4 * (len(a) + len(b))


def signature(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - 2**63


def frequent(told: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the rows holds often, sorted, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text), pa.int64())], names=["shingle"])

    some = told.filter(F.pmod(F.xxhash64("at"), F.lit(SAMPLED)) == 0).select(F.col("row.text").cast("string").alias("text"))
    counts = some.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter("n >= 4")
    rows = counts.orderBy(F.desc("n"), "shingle").limit(FREQUENT).collect()
    found = np.array([(r["shingle"], r["n"]) for r in rows], np.int64).reshape(-1, 2)
    found = found[np.argsort(found[:, 0])]
    return found[:, 0], found[:, 1]


def prefixes(told: DataFrame, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(shingle, n, node, pos): the first shingles of every row's set, rarest first."""
    known, counts = often

    def ordered(found: np.ndarray) -> np.ndarray:
        if not len(known):
            return found
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        return found[np.lexsort((found, np.where(known[at] == found, counts[at], 0)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, sizes, nodes, places = [], [], [], []
            for text in batch.column(0).to_pylist():
                found = shingles(text)
                n = len(found)
                head = ordered(found)[: n - (4 * n + 4) // 5 + 1]
                first.append(head)
                sizes.append(np.full(len(head), n, np.int32))
                nodes.append(np.full(len(head), signature(found), np.int64))
                places.append(np.arange(len(head), dtype=np.int32))
            columns = [np.concatenate(c) for c in (first, sizes, nodes, places)] if first else [np.zeros(0, np.int64)] * 4
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["shingle", "n", "node", "pos"])

    return told.select(F.col("row.text").cast("string").alias("text")).mapInArrow(run, "shingle long, n int, node long, pos int")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle, size and node, those with a neighbour of like size; equal rows once."""
    names = ["shingle", "n", "node", "pos"]
    held, flag = np.zeros((4, 0), np.int64), False

    def out(rows: np.ndarray) -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(r.astype(t.to_pandas_dtype())) for r, t in zip(rows, types, strict=True)], names=names)

    for batch in batches:
        new = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
        rows = np.concatenate([held, new], axis=1)
        if not rows.shape[1]:
            continue
        fresh = np.ones(rows.shape[1], bool)
        fresh[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[2, 1:] != rows[2, :-1])
        rows = rows[:, fresh]
        near = (rows[0, 1:] == rows[0, :-1]) & (5 * rows[1, :-1] >= 4 * rows[1, 1:])
        told = np.zeros(rows.shape[1], bool)
        told[0] = flag
        told[1:] |= near
        told[:-1] |= near
        yield out(rows[:, :-1][:, told[:-1]])
        held, flag = rows[:, -1:], bool(told[-1])
    if flag:
        yield out(held)


def _sets(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["node", "found"])

    return rows.mapInArrow(run, "node long, found binary")


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = [[np.frombuffer(x, np.int64) for x in batch.column(c).to_pylist()] for c in ("fa", "fb")]
        hit = pa.array([similar(x, y) for x, y in zip(*sides, strict=True)], pa.bool_())
        yield batch.select(["a", "b"]).filter(hit)


def _possible(n: Column, m: Column, p: Column, q: Column) -> Column:
    """Sets of these sizes whose first common shingle has these positions may be similar."""
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * F.least(n - p, m - q) >= 4 * (n + m))


def near_links(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root) of all nodes that have a near copy."""
    left, right = sets.toDF("a", "fa"), sets.toDF("b", "fb")
    links, roots = None, None
    for turn in range(CENTRES + 1):
        named = shared.withColumn("of", F.col("node"))
        if roots is not None:
            named = shared.join(roots.withColumnRenamed("root", "of"), "node", "left").withColumn("of", F.coalesce("of", "node"))
        one = named.select("shingle", F.col("node").alias("a"), "n", "pos", F.col("of").alias("x"))
        if turn < CENTRES:
            drawn = F.min(F.struct(F.xxhash64("a", F.lit(turn)).alias("draw"), "a", "n", "pos", "x")).alias("c")
            two = one.groupBy("shingle").agg(drawn)
            two = two.select("shingle", F.col("c.a").alias("b"), F.col("c.n").alias("m"), F.col("c.pos").alias("q"), F.col("c.x").alias("y"))
            apart = F.col("x") != F.col("y")
        else:
            two = one.toDF("shingle", "b", "m", "q", "y")
            apart = (F.col("x") != F.col("y")) & (F.col("a") < F.col("b"))
        met = one.join(two, "shingle").filter(apart & _possible(F.col("n"), F.col("m"), F.col("pos"), F.col("q")))
        met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = written(met.join(left, "a").join(right, "b").mapInArrow(_confirmed, "a long, b long"), "links")
        links = new if links is None else links.union(new)
        roots = components(links)
    return roots


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: the smallest id (null ids last, then the earliest row).

    Texts without words are copies of each other; an empty table gives no rows;
    all columns are kept as they are.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    told = written(docs.select(packed_row(docs), F.monotonically_increasing_id().alias("at")), "rows")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([signature(shingles(t)) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["at", "id", "node"])

    texts = told.select("at", F.col("row.doc_id").cast("long").alias("id"), F.col("row.text").cast("string").alias("text"))
    nodes = written(texts.mapInArrow(signed, "at long, id long, node long"), "nodes")
    dealt = prefixes(told, frequent(told)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shingle")
    shared = dealt.sortWithinPartitions("shingle", "n", "node").mapInArrow(_shared, "shingle long, n int, node long, pos int")
    shared = written(shared, "shared")
    wanted = nodes.groupBy("node").agg(F.min("at").alias("at")).join(shared.select("node").distinct(), "node", "left_semi")
    sets = written(_sets(texts.join(wanted, "at").select("node", "text")), "sets")
    named = nodes.join(near_links(shared, sets), "node", "left").withColumn("cluster", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at"))
    kept = named.groupBy("cluster").agg(first.alias("first")).select("first.at")
    return told.join(kept, "at", "left_semi").select("row.*")
