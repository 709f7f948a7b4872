"""Hash trees over dotted keys, and the differences between two of them.

Nodes are rows (level, path, segment, parent, hash). An interior hash covers
its children in byte order of their segments, so a parent's children meet in
one row; keys are laid out so that no parent has very many of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "."


def interior(children: Column) -> Column:
    """SHA-256 over (segment bytes, 32 hash bytes) of each child in order."""
    ordered = F.transform(F.array_sort(children), lambda c: F.concat(F.hex(F.encode(c["segment"], "utf-8")), c["hash"]))
    return F.sha2(F.unhex(F.array_join(ordered, "")), 256)


def parents(nodes: DataFrame) -> DataFrame:
    """The level above."""
    made = nodes.groupBy(F.col("parent").alias("path")).agg(interior(F.collect_list(F.struct("segment", "hash"))).alias("hash"))
    return placed(made)


def placed(nodes: DataFrame) -> DataFrame:
    """``path`` and ``hash`` with level, segment and parent; the root's path is empty."""
    root = F.col("path") == ""
    segment = F.substring_index("path", SEPARATOR, -1)
    parent = F.when(
        F.col("path").contains(SEPARATOR), F.expr(f"substring(path, 1, length(path) - length(substring_index(path, '{SEPARATOR}', -1)) - 1)")
    ).otherwise("")
    level = F.when(root, 0).otherwise(F.size(F.split("path", r"\.")))
    return nodes.select(
        level.cast("int").alias("level"), "path", F.when(~root, segment).alias("segment"),
        F.when(~root, parent).alias("parent"), "hash",
    )


def tree(leaves: DataFrame, depth: int) -> list[DataFrame]:
    """Levels 0 (root) to ``depth`` (leaves) of leaves ``path``, ``hash`` that all lie ``depth`` deep."""
    levels = [placed(leaves)]
    for _ in range(depth):
        levels.insert(0, parents(levels[0]))
    return levels


def stored_tree(leaves: DataFrame, depth: int, store: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """The same with every level stored, so that each is made once, of the one below."""
    levels = [placed(leaves)]
    for _ in range(depth):
        levels.insert(0, store(parents(levels[0])))
    return levels


def children(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.filter(F.col("parent") == path).orderBy("segment").select("segment", "hash")


def compare_roots(local: DataFrame, remote: DataFrame) -> DataFrame:
    """One row: ``in_sync``, ``both_absent``, ``local_only`` or ``differs``."""
    sides = local.select(F.lit("l").alias("side"), "hash").union(remote.select(F.lit("r"), "hash"))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("hash")))
    roots = sides.agg(of("l").alias("local_hash"), of("r").alias("remote_hash"))
    verdict = (
        F.when(F.col("local_hash").isNull() & F.col("remote_hash").isNull(), "both_absent")
        .when(F.col("local_hash").eqNullSafe(F.col("remote_hash")), "in_sync")
        .when(F.col("remote_hash").isNull(), "local_only")
        .otherwise("differs")
    )
    return roots.select("local_hash", "remote_hash", verdict.alias("verdict"))


def differing(local: DataFrame, remote: DataFrame, below: DataFrame | None = None) -> DataFrame:
    """Nodes of one level that are not equal: ``fetch`` (remote only or changed) or ``delete`` (local only).

    With ``below`` only children of its paths count; they are picked before
    the two sides meet, in one pass over both.
    """
    sides = local.select("path", "hash", F.lit("l").alias("side"), *(["parent"] if below is not None else []))
    sides = sides.unionByName(remote.select("path", "hash", F.lit("r").alias("side"), *(["parent"] if below is not None else [])))
    if below is not None:
        sides = sides.join(below.select(F.col("path").alias("parent")), "parent", "left_semi")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("hash")))
    both = sides.groupBy("path").agg(of("l").alias("l"), of("r").alias("r")).filter(~F.col("l").eqNullSafe(F.col("r")))
    return both.select("path", F.when(F.col("r").isNull(), "delete").otherwise("fetch").alias("action"))


def drill_down(local: list[DataFrame], remote: list[DataFrame]) -> DataFrame:
    """Leaf keys that differ, level by level below branches that do.

    Each level keeps only children of differing parents, so equal subtrees are
    dropped as high as they are equal; a level reads what the level above found
    once. Where leaves are as cheap to read as nodes, ``differing`` on the
    leaves alone says the same with one exchange.
    """
    found = differing(local[0], remote[0])
    for a, b in zip(local[1:], remote[1:], strict=True):
        found = differing(a, b, found)
    return found.withColumnRenamed("path", "key")


def leaves_below(leaves: DataFrame, branches: DataFrame, level: int) -> DataFrame:
    """Leaves under ``branches`` (``path`` at ``level``), found by equality on the ancestor."""
    ancestor = F.array_join(F.slice(F.split("path", r"\."), 1, level), SEPARATOR)
    below = branches.select(F.col("path").alias("_ancestor"))
    return leaves.join(below, ancestor == F.col("_ancestor"), "left_semi")


def clean_branches(levels: DataFrame, dirty: DataFrame) -> DataFrame:
    """Branches without a key that waits for recalculation."""
    waiting = dirty.select(F.col("parent").alias("path")).distinct()
    return levels.join(waiting, "path", "left_anti").select("path", "hash")
