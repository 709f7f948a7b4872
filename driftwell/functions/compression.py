"""Conditional zstd decompression, in Arrow batches."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

MAGIC = b"\x28\xb5\x2f\xfd"


def decode_frame(frame: bytes) -> tuple[bytes | None, str | None]:
    """(data, None), or (None, error) for a bad or truncated frame."""
    try:
        with pa.CompressedInputStream(pa.BufferReader(frame), "zstd") as stream:
            return stream.read(), None
    except (OSError, pa.ArrowException) as e:
        return None, str(e)[:200] or "bad frame"


_DECODED = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("error", T.StringType())])


@pandas_udf(_DECODED)
def decoded(frames: pd.Series) -> pd.DataFrame:
    """Rows without a frame (NULL) cost nothing but their place in the batch."""
    rows = [decode_frame(bytes(f)) if f is not None else (None, None) for f in frames]
    return pd.DataFrame(rows, columns=["data", "error"])


def has_magic(data: Column) -> Column:
    return F.coalesce(F.substring(data, 1, 4) == F.lit(MAGIC), F.lit(False))
