"""Positions ``{ms}-{seq}``: both unsigned 64-bit, compared as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNSIGNED = "decimal(20,0)"
_MOST = "18446744073709551615"
BEGINNING = "0"


def unsigned(text: Column) -> Column:
    """A text as unsigned 64-bit number, NULL unless it is one."""
    # try_cast alone takes blanks and fractions.
    number = F.when(text.rlike(r"^\+?[0-9]+$"), text).try_cast("decimal(38,0)")
    return F.when(number <= F.lit(_MOST).cast("decimal(38,0)"), number.cast(UNSIGNED))


def position_ms(stream_id: Column) -> Column:
    parts = F.split(stream_id, "-")
    zero = F.lit(0).cast(UNSIGNED)
    return F.coalesce(F.when(F.size(parts) == 2, unsigned(F.get(parts, F.lit(0)))).otherwise(unsigned(stream_id)), zero)


def position_seq(stream_id: Column) -> Column:
    parts = F.split(stream_id, "-")
    return F.coalesce(F.when(F.size(parts) == 2, unsigned(F.get(parts, F.lit(1)))), F.lit(0).cast(UNSIGNED))


def position(stream_id: Column) -> Column:
    """Ordered struct of a position; unreadable parts count as 0."""
    return F.struct(position_ms(stream_id).alias("ms"), position_seq(stream_id).alias("seq"))


def timestamp_ms(stream_id: Column) -> Column:
    """Milliseconds of a position with two parts, else NULL; the second part is not checked."""
    parts = F.split(stream_id, "-")
    return F.when(F.size(parts) == 2, unsigned(F.get(parts, F.lit(0))))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as the first position is before, at or after the second."""
    x, y = position(a), position(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def lag_ms(cursor: Column, latest: Column) -> Column:
    """How far the cursor is behind, never negative; NULL if either has no timestamp."""
    c, n = timestamp_ms(cursor), timestamp_ms(latest)
    return F.when(c.isNotNull() & n.isNotNull(), F.greatest(n - c, F.lit(0).cast("decimal(21,0)")))


def after(ms: Column, seq: Column, bound_ms: int, bound_seq: int) -> Column:
    """Strictly after a position, on plain columns so that the bound reaches a file scan."""
    return (ms >= bound_ms) & ((ms > bound_ms) | (seq > bound_seq))
