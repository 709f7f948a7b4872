"""Mixing sources to target weights by weighted sampling without replacement.

A document's exponential key is ``-ln(u) / quality`` with u drawn from a hash
of the document (Efraimidis-Spirakis): the smallest keys are a sample weighted
by quality. A source takes as many complete epochs as its target holds and
fills the rest in key order; the document at the budget's end is cut there.

The order is never laid out as a whole. Keys fall into fixed slices; sizes per
slice are summed first, whole slices lie before or behind the budget, and only
the slice that the budget ends in is sorted. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, packed_row, text_or_empty, words, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SLICES = 4096
SEED = "mix-1"


def quality(text: Column) -> Column:
    """A quality weight in (0, 1]: the share of ASCII letters, never below 0.05."""
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]+", ""))
    return F.greatest(F.lit(0.05), letters / F.greatest(F.lit(1), F.length(text)))


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights=WEIGHTS) -> DataFrame:
    """Targets of sources (``source``, ``source_size``), excess reshared until none is above its cap.

    Sources by code point, null last, take the weights in turn. Sharing the
    excess again and again ends where every uncapped source gets the same
    amount per weight: sources are ordered by cap per weight, and the first
    amount that the next cap allows is taken. One row per source is held.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.get(kinds, (F.row_number().over(order) - 1) % len(weights)))
    rows = rows.withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    earlier, later = (
        by_cap.rowsBetween(Window.unboundedPreceding, -1),
        by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing),
    )
    every = Window.partitionBy(F.lit(0))
    rows = rows.withColumn(
        "rate",
        (F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
        / F.sum("weight").over(later),
    )
    fits = F.col("rate") * F.col("weight") <= F.col("cap")
    rate = F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), F.col("rate").alias("rate")))).over(every)
    rows = rows.withColumn("level", rate["rate"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_size", target.alias("target"))


def mix_keys(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, source, size and exponential key of every row.

    With ``carry`` each row keeps all of its columns in the struct ``row``.
    """
    text = text_or_empty()
    digest = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text)))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        n_words(text).alias("size"),
        (-F.log(uniform) / quality(text)).alias("key"),
        digest.alias("digest"),
        *([packed_row(docs)] if carry else []),
    )


def mix(rows: DataFrame) -> DataFrame:
    """How many words the mix takes of each row of ``mix_keys``.

    Null sources form one source of their own; rows without words take none;
    equal rows share a key and are told apart by order only, which changes no
    result. Keys are compared in slices of ``key / (1 + key)``.
    """
    rows = rows.withColumn("slice", F.floor(F.col("key") / (F.col("key") + 1) * SLICES).cast("int"))
    sums = written(rows.groupBy("source", "slice").agg(F.sum("size").alias("held")), "slices")
    targets = written(source_targets(sums.groupBy("source").agg(F.sum("held").alias("source_size"))), "targets")
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        sums.withColumn("base", F.coalesce(F.sum("held").over(before), F.lit(0)))
        .alias("s")
        .join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .withColumn("budget", F.round("target").cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))))
        .withColumn("rest", F.col("budget") - F.coalesce(F.col("epochs"), F.lit(0)) * F.col("source_size"))
    )
    # The slice the budget ends in; none if the budget is whole epochs.
    ends = (F.col("base") < F.col("rest")) & (F.col("base") + F.col("held") > F.col("rest"))
    edge = written(
        plan.groupBy("s.source", "source_size", "target", "rest")
        .agg(
            F.coalesce(F.max("epochs"), F.lit(0)).alias("epochs"),
            F.max(F.when(ends, F.struct("slice", "base"))).alias("edge"),
            F.coalesce(F.max(F.when(F.col("base") + F.col("held") <= F.col("rest"), F.col("slice"))), F.lit(-1)).alias(
                "whole"
            ),
        )
        .select("source", "source_size", "target", "rest", "epochs", "whole", "edge.slice", "edge.base"),
        "edges",
    ).withColumnsRenamed({"source": "of", "slice": "edge"})
    told = rows.join(edge, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    inside = F.coalesce(F.col("slice") == F.col("edge"), F.lit(False))
    whole = F.when(F.col("slice") <= F.col("whole"), F.col("size")).otherwise(F.lit(0))
    out = ["doc_id", "source", "size", "source_size", "target", "epochs"] + ["row"] * ("row" in rows.columns)
    plain = told.filter(~inside).select(*out, whole.alias("part"))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "digest")
    sorted_ = told.filter(inside).withColumn(
        "sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    upto = F.col("base") + F.col("sum") - F.col("size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - upto))
    both = plain.unionByName(sorted_.select(*out, cut.alias("part")))
    return both.select(*out, "part", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``docs``."""
    return mix(written(mix_keys(docs), "keys")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of the mix with the columns of ``docs``.

    A row is repeated for every epoch and once more if the fraction takes it; a
    row that the budget cuts appears there with its first words only. Rows the
    mix takes no words of do not appear.
    """
    told = mix(written(mix_keys(docs, carry=True), "keys"))
    copies = F.sequence(F.lit(1).cast("long"), F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0))
    told = told.filter((F.col("taken") > 0)).withColumn("copy", F.explode(copies))
    cut = (F.col("copy") > F.col("epochs")) & (F.col("part") < F.col("size"))
    short = F.array_join(F.slice(words(F.col("row.text")), F.lit(1), F.col("part").cast("int")), " ")
    text = F.when(cut, short).otherwise(F.col("row.text"))
    fields = [text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return told.select(*fields)


#: The same in DuckDB; sorts each source at once.
ORACLE = r"""
WITH k AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
d AS (SELECT doc_id, source, size, md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(t)) AS digest,
         greatest(0.05::DOUBLE, length(regexp_replace(t, '[^A-Za-z]+', '', 'g'))::DOUBLE / greatest(1, length(t))) AS q
      FROM k),
e AS (SELECT *, -ln((('0x' || substr(digest, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / q AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
      FROM e GROUP BY source),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, row_number() OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST) AS o FROM s),
r AS (SELECT *, ((SELECT sum(source_size) FROM c)::DOUBLE * 1.5::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM c),
l AS (SELECT arg_min(rate, o) AS level FROM r WHERE rate * weight <= cap),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM l) * weight, cap)) AS target FROM r),
b AS (SELECT *, round(target)::BIGINT AS budget FROM t),
p AS (SELECT e.doc_id, e.size, b.source_size, b.target, b.budget,
         CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS epochs,
         coalesce(sum(e.size) OVER (PARTITION BY e.source ORDER BY e.key, e.doc_id, e.digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
      FROM e JOIN b ON e.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - upto)))::BIGINT AS taken
FROM p
"""
