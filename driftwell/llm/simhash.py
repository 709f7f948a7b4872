"""SimHash near-duplicates by pigeonring filtering.

Fingerprints are cut into five segments laid on a ring. If two differ in at
most t bits, then from some segment on every chain of consecutive segments
differs in at most its share of t: after l segments, in no more than
``l * t / 5`` bits (the pigeonring principle, stronger than finding one equal
segment). For t = 4 a viable chain begins with an equal segment followed by one
that differs in one bit at most, which can be joined by equality: every
fingerprint is filed under its five two-segment keys and asks under the keys
with one bit of the second segment changed. Pairs that meet go on along the
chain, and only those whose chain stays within budget get the full distance.

Equal fingerprints are one node. Inside a file only links that join what was
apart are kept, so a large group of near copies gives as many links as members,
not pairs; components are then found by hooking and pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, forget, packed_row, written

SHINGLE, SEED, BITS, LIMIT = 4, 42, 64, 4
WIDTHS = (13, 13, 13, 13, 12)
#: Fingerprints filed under one key that are compared by one task; more are split.
BLOCK = 8192
#: Tasks that the members of one component are dealt to when they learn its smallest id.
SALTS = 32
#: Components whose smallest ids may be broadcast, 16 bytes each.
SENT = 100_000

# The contract's word boundaries and lower-casing, A-Z only.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def split_words(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).translate(_SPACES).split(b" ")
    return [w for w in words if w]


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of the text's word shingles; 0 without words."""
    words = split_words(text)
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    digest, view = xxhash.xxh64_intdigest, memoryview(line)
    hashes = np.array([digest(view[a : b - 1], SEED) for a, b in zip(starts, last, strict=False)], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > n
    return int(np.packbits(over, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp`` (signed) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(map(fingerprint, batch.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def segments(fp: np.ndarray) -> list[np.ndarray]:
    out, shift = [], 0
    for w in WIDTHS:
        out.append(fp >> np.uint64(shift) & np.uint64((1 << w) - 1))
        shift += w
    return out


def filed(distinct: DataFrame) -> DataFrame:
    """(key, asks, fp): each fingerprint under its own keys and, asking, under those one bit away."""
    m = len(WIDTHS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = segments(signed.view(np.uint64))
            for i in range(m):
                first, second, width = parts[i], parts[(i + 1) % m], WIDTHS[(i + 1) % m]
                base = (np.uint64(i) << np.uint64(32) | first << np.uint64(16)).astype(np.int64)
                for flip in range(-1, width):
                    key = base | (second if flip < 0 else second ^ np.uint64(1 << flip)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(np.full(len(key), flip >= 0)), pa.array(signed)], names=["key", "asks", "fp"]
                    )

    return distinct.select("fp").mapInArrow(run, "key long, asks boolean, fp long")


def viable(a: np.ndarray, b: np.ndarray, start: int | np.ndarray) -> np.ndarray:
    """Whether chains from ``start`` stay within their share of the limit, then the full distance."""
    m = len(WIDTHS)
    x = a ^ b
    counts = np.stack([np.bitwise_count(s) for s in segments(x)]).astype(np.int64)
    ok, total = np.ones(x.shape, bool), np.zeros(x.shape, np.int64)
    for step in range(m):
        total = total + np.take_along_axis(counts, np.broadcast_to((np.asarray(start) + step) % m, (1, *x.shape)), 0)[0]
        ok &= total * m <= (step + 1) * LIMIT
    return ok & (np.bitwise_count(x) <= LIMIT)


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _chunk_links(own: np.ndarray, others: np.ndarray, start: int, forest: _Forest) -> list[tuple[int, int]]:
    """Links between two sets that join trees of ``forest``."""
    out, rows = [], max(1, 2_000_000 // max(1, len(own)))
    for at in range(0, len(others), rows):
        part = others[at : at + rows]
        hit = viable(part[:, None].view(np.uint64), own[None].view(np.uint64), start)
        i, j = np.nonzero(hit)
        out += [(a, b) for a, b in zip(part[i].tolist(), own[j].tolist(), strict=True) if a != b and forest.join(a, b)]
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of files that come sorted by (key, block, asks).

    A file's own fingerprints come first and are held (at most a block); those
    that ask are compared as they come.
    """

    def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held_key, held, forest = None, np.zeros(0, np.int64), _Forest()
    for batch in batches:
        key = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
        block = batch.column("block").to_numpy(zero_copy_only=False).astype(np.int64)
        asks = batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(key):
            continue
        new = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1
        begins, ends = np.concatenate([[0], new]), np.concatenate([new, [len(key)]])
        # Most files hold one fingerprint and nobody asks, or nobody is asked.
        size = ends - begins
        own = np.add.reduceat(~asks, begins)
        busy = (size > 1) & (own > 0)
        busy[0] = busy[-1] = True
        links: list[tuple[int, int]] = []
        for x in np.flatnonzero(busy).tolist():
            a, b = int(begins[x]), int(ends[x])
            k = (int(key[a]), int(block[a]))
            if k != held_key:
                held_key, held, forest = k, np.zeros(0, np.int64), _Forest()
            mine, others = fp[a:b][~asks[a:b]], fp[a:b][asks[a:b]]
            start = k[0] >> 32
            if len(mine):
                links += _chunk_links(np.concatenate([held, mine]), mine, start, forest)
                held = np.concatenate([held, mine])
            if len(others) and len(held):
                links += _chunk_links(held, others, start, forest)
        yield out(links)


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within the limit.

    Keys with more than BLOCK own fingerprints are split into blocks; every
    fingerprint of such a key, own or asking, is compared with every block.
    """
    spark = distinct.sparkSession
    rows = filed(distinct)
    own = rows.filter(~F.col("asks")).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    hot = written(own.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "hot")
    zero = F.lit(0).cast("int")
    if hot.isEmpty():
        dealt = rows.withColumn("block", zero)
    else:
        told = rows.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        home = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        first = told.filter(~F.col("asks")).withColumn("block", home)
        rest = told.filter((F.col("blocks") > 1) | F.col("asks")).withColumn("asks", F.lit(True))
        rest = rest.withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        dealt = first.unionByName(rest).drop("blocks")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = dealt.repartition(n, "key", "block").sortWithinPartitions("key", "block", "asks")
    return grouped.mapInArrow(_links, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links``; the root is the component's smallest node.

    Each round every node takes the smallest root among its neighbours' and
    then its root's root, so path lengths halve; the links are rewritten to
    roots and those inside a component go. Ends when no link is left.
    """
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y"))
    edges = written(both.filter("x != y").distinct(), "links")
    nodes = edges.select(F.col("x").alias("node")).union(edges.select("y")).distinct()
    roots = written(nodes.withColumn("root", F.col("node")), "roots")
    while not edges.isEmpty():
        ends = edges.union(edges.select("y", "x"))
        hook = ends.groupBy("x").agg(F.min("y").alias("to")).filter("to < x")
        held = hook = written(hook, "hooks")
        # Hooks only go down, so following them ends at a root; double them until they do.
        while True:
            far = hook.alias("h").join(hook.alias("g"), F.col("h.to") == F.col("g.x"), "left")
            far = written(far.select("h.x", F.coalesce("g.to", "h.to").alias("to"), F.col("g.to").isNotNull().alias("moved")), "hooks")
            forget(held)
            still, held, hook = far.filter("moved").isEmpty(), far, far.drop("moved")
            if still:
                break
        stepped = roots.join(hook, F.col("root") == F.col("x"), "left")
        before, roots = roots, written(stepped.select("node", F.coalesce("to", "root").alias("root")), "roots")
        a, b = hook.toDF("xa", "ta"), hook.toDF("xb", "tb")
        moved_links = edges.join(a, F.col("x") == F.col("xa"), "left").join(b, F.col("y") == F.col("xb"), "left")
        moved_links = moved_links.select(F.coalesce("ta", "x").alias("x"), F.coalesce("tb", "y").alias("y"))
        done, edges = edges, written(moved_links.filter("x != y").distinct(), "links")
        forget(held, before, done)
    forget(edges)
    return roots


def clusters(docs: DataFrame) -> DataFrame:
    """doc_id, fp, cluster (a fingerprint of the component) and component_id per row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other; rows
    with null ids are members, but ``component_id`` is the smallest id that is
    not null (null if there is none); repeated rows fall together; an empty
    table gives no rows; columns other than ``doc_id`` and ``text`` are not read.
    """
    rows = written(fingerprints(docs), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(near_links(nodes))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumnRenamed("root", "cluster")
    linked = written(linked, "members")
    # A component may hold a third of all fingerprints: its members meet its smallest id in several tasks.
    members, alone = linked.filter("cluster IS NOT NULL"), linked.filter("cluster IS NULL")
    least = written(members.groupBy("cluster").agg(F.min("least").alias("component_id")), "least")
    if least.count() <= SENT:
        told = members.join(F.broadcast(least), "cluster").select("fp", "cluster", "component_id")
    else:
        # Never broadcast: Spark takes the size before the salts for that of the copies.
        spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        salted = members.select("fp", "cluster", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt"))
        told = salted.join(spread, ["cluster", "salt"]).select("fp", "cluster", "component_id")
    named = written(told.unionByName(alone.select("fp", F.col("fp").alias("cluster"), F.col("least").alias("component_id"))), "named")
    forget(nodes, roots, linked, least)
    return rows.join(named, "fp").select("doc_id", "fp", "cluster", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the smallest id (null ids last, then the earliest row)."""
    told = written(docs.select(packed_row(docs), F.monotonically_increasing_id().alias("at")), "rows")
    named = clusters(told.select(F.col("at").alias("doc_id"), "row.text")).select(F.col("doc_id").alias("at"), "cluster")
    ranked = told.select("at", F.col("row.doc_id").cast("long").alias("id")).join(named, "at")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at"))
    kept = ranked.groupBy("cluster").agg(first.alias("first")).select("first.at")
    return told.join(kept, "at", "left_semi").select("row.*")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return clusters(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")
