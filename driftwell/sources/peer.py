"""A peer's logical tables: roots, child lists and items under prefixed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing


def root(nodes: DataFrame) -> DataFrame:
    """The root hash as 32 bytes; no row if it is absent or malformed."""
    found = nodes.filter("level = 0").select(parsing.node_hash(F.col("hash")).alias("hash"))
    return found.filter("hash IS NOT NULL")


def children(nodes: DataFrame) -> DataFrame:
    """All child lists at once (parent, segment, hash bytes); children without a hash are left out."""
    found = nodes.filter("level > 0").select("parent", "segment", parsing.node_hash(F.col("hash")).alias("hash"))
    return found.filter("hash IS NOT NULL")


def items(keys: DataFrame, stored: DataFrame, prefix: str) -> DataFrame:
    """Content for every key: a JSON document's payload, or the value as it is; NULL if missing."""
    told = keys.withColumn("stored_key", parsing.prefixed(F.lit(prefix), F.col("key")))
    both = told.join(stored.select("stored_key", "value"), "stored_key", "left")
    return both.select("key", parsing.payload(F.col("value")).alias("content"))
