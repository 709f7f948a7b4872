"""Shared folders and landed files; everything goes through Spark's file systems."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a private one only where that is unset and Spark runs in one process.

    It is removed when the interpreter ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="driftwell-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/driftwell/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark keeps it; no error if the session has ended."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have been stopped before the interpreter ends
        return


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def mark(spark: SparkSession, path: str) -> None:
    """An empty file."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True).close()


def size(spark: SparkSession, path: str) -> int:
    """Bytes of the files below a folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it is not there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(target)] if system.exists(target) else []


def land(feed: DataFrame, folder: str, files: int = 1) -> None:
    """Append a feed to a landing folder in ``files`` files of consecutive positions."""
    feed.repartitionByRange(files, "ms", "seq").write.mode("append").parquet(folder)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table that is read several times once, below the shared folder."""
    path, schema = work_folder(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def tail(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over a landing folder; ``files_per_trigger`` bounds what one batch reads."""
    reader = spark.readStream.schema(like.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)
