"""From raw log entries to checked changes, one projection without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import positions
from .compression import decoded, has_magic

META = "struct<content_type:string,version:decimal(20,0),updated_at:bigint,trace_parent:string>"


def text_field(field: Column) -> Column:
    """Bytes as text, NULL if they are not UTF-8."""
    return F.try_validate_utf8(field.cast("binary").cast("string"))


def operation(op: Column) -> Column:
    """``PUT`` or ``DELETE`` in any case (``DEL`` too), else NULL."""
    up = F.upper(op)
    return F.when(up == "PUT", "PUT").when(up.isin("DEL", "DELETE"), "DELETE")


def content_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def meta(text: Column) -> Column:
    """The metadata struct, NULL unless all required fields are there and of their JSON type.

    A number in quotes is no number, a number no text; a trace may be absent or
    null but not of another type. A field named twice makes the document invalid.
    """
    document, raw = F.try_parse_json(text), F.from_json(text, "version string, updated_at string")
    field = lambda name, kind: F.try_variant_get(document, f"$.{name}", kind)
    kind = lambda name: F.schema_of_variant(field(name, "variant"))
    # A variant takes 5.0 for 5; the document's own text tells them apart.
    whole = lambda name: F.when((kind(name) != "STRING") & raw[name].rlike("^-?[0-9]+$"), raw[name])
    content = F.when(kind("content_type") == "STRING", field("content_type", "string"))
    version, updated = positions.unsigned(whole("version")), whole("updated_at").try_cast("bigint")
    trace = kind("trace_parent")
    good = content.isNotNull() & version.isNotNull() & updated.isNotNull() & (trace.isNull() | trace.isin("STRING", "VOID"))
    made = F.struct(
        content.alias("content_type"), version.alias("version"), updated.alias("updated_at"),
        field("trace_parent", "string").alias("trace_parent"),
    )
    return F.when(good, made)


def trace_id(trace_parent: Column) -> Column:
    return F.get(F.split(trace_parent, "-"), F.lit(1))


def parent_span_id(trace_parent: Column) -> Column:
    return F.get(F.split(trace_parent, "-"), F.lit(2))


def prefixed(prefix: Column, key: Column) -> Column:
    """The prefix carries its own colon; a missing one is empty."""
    return F.concat(F.coalesce(prefix, F.lit("")), key)


def node_hash(text: Column) -> Column:
    """32 bytes from 64 hexadecimal digits, else NULL."""
    return F.when(text.rlike("^[0-9a-fA-F]{64}$"), F.unhex(text))


def payload(document: Column) -> Column:
    """First element of a JSON array as JSON (NULL if empty), any other text as it is: a string keeps its quotes."""
    is_array = document.rlike(r"^\s*\[") & F.json_array_length(document).isNotNull()
    first = F.get_json_object(document, "$[0]")
    quoted = F.regexp_extract(F.to_json(F.array(first)), r"(?s)^\[(.*)\]$", 1)
    element = (
        F.when(document.rlike(r'^\s*\[\s*"'), quoted)
        .when(document.rlike(r"^\s*\[\s*null\s*[,\]]"), "null")
        .otherwise(first)
    )
    return F.when(is_array, element).otherwise(document)


def parse(feed: DataFrame, compressed: bool = True) -> DataFrame:
    """Entries with ``ms``, ``seq``, typed fields and ``reject_reason`` (NULL if valid).

    ``feed`` has ``stream_id`` and the fields ``op``, ``key``, ``hash``, ``data``
    and ``meta`` as bytes or text; further columns are kept. Checks run in order:
    operation, key, and for PUT data, compression, hash. A DELETE carries no
    hash, data or metadata even if the entry does. ``compressed=False`` is for
    feeds known to hold no compressed payload and keeps Python out of the plan.
    """
    made = ("stream_id", "op", "key", "hash", "data", "meta", "ms", "seq", "reject_reason")
    extra = [c for c in feed.columns if c not in made]
    data = F.col("data").cast("binary")
    rows = feed.select(
        *extra,
        "stream_id",
        positions.position_ms(F.col("stream_id")).alias("ms"),
        positions.position_seq(F.col("stream_id")).alias("seq"),
        F.col("op").isNull().alias("_no_op"),
        operation(text_field(F.col("op"))).alias("op"),
        text_field(F.col("key")).alias("key"),
        text_field(F.col("hash")).alias("hash"),
        (F.col("hash").isNotNull() & text_field(F.col("hash")).isNull()).alias("_bad_hash"),
        data.alias("data"),
        text_field(F.col("meta")).alias("_meta"),
    )
    if compressed:
        frame = F.when(has_magic(F.col("data")), F.col("data"))
        rows = rows.withColumn("_plain", decoded(frame))
        rows = rows.withColumn("_bad_frame", has_magic(F.col("data")) & F.col("_plain.error").isNotNull())
        rows = rows.withColumn("data", F.when(has_magic(F.col("data")), F.col("_plain.data")).otherwise(F.col("data")))
        rows = rows.drop("_plain")
    else:
        rows = rows.withColumn("_bad_frame", F.lit(False))
    put = F.col("op") == "PUT"
    reason = (
        F.when(F.col("_no_op"), "missing_op")
        .when(F.col("op").isNull(), "unknown_op")
        .when(F.col("key").isNull(), "missing_key")
        .when(put & F.col("_bad_hash"), "bad_hash_field")
        .when(put & F.coalesce("_bad_frame", F.lit(False)), "bad_frame")
        .when(put & F.col("data").isNull(), "missing_data")
        .when(put & F.col("hash").isNotNull() & (content_hash(F.col("data")) != F.col("hash")), "hash_mismatch")
    )
    return rows.select(
        *extra, "stream_id", "ms", "seq", "op", "key",
        F.when(put, F.col("hash")).alias("hash"), F.when(put, F.col("data")).alias("data"),
        F.when(put, meta(F.col("_meta"))).cast(META).alias("meta"), reason.alias("reject_reason"),
    )


def valid(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reject_reason IS NULL").drop("reject_reason")


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reject_reason IS NOT NULL")
