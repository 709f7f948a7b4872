"""Shared helpers: written intermediate tables and safe column access."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import landing

#: ASCII white space as the operators' contracts define a word boundary.
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with a table any executor can read again, so that ids
    assigned while writing (partition numbers, ranks) stay as they were when an
    executor is lost later. The table is removed when the interpreter ends, or
    by ``discard``.
    """
    spark = df.sparkSession
    path, schema = landing.work_folder(spark, name), df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that nothing reads any more, and the exchanges they were made by.

    Spark frees the files of an exchange when the driver's collector finds the
    exchange unused; a driver with little work may not collect for a long time.
    """
    forget(*tables)
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def forget(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for table in tables:
        landing.remove(table.sparkSession, table._written_to)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, so that very long texts come few at a time."""
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    except Exception:  # a Spark without that setting gets a lower row bound instead
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def packed_row(df: DataFrame) -> Column:
    """All columns as one struct ``row``, so that none of their names can clash with an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of maximal runs outside ASCII white space, as long."""
    return F.regexp_count(text, F.lit(WORD + "+")).cast("long")


def words(text: Column) -> Column:
    """Array of the words of ``text``; a text without words gives an empty array."""
    return F.filter(F.split(text, WS + "+"), lambda w: w != "")
