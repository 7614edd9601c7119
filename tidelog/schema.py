"""The change log's schema and its rules.

A row is a write: ``deleted`` false with a value, or a tombstone with none. ``(gen, seq)`` orders writes of one key; it
must be unique per key. Time is a plain integer without unit or zone; negative times are legal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = T.StructType(
    [
        T.StructField("series_id", T.LongType(), False),
        T.StructField("ts", T.LongType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("gen", T.LongType(), False),
        T.StructField("deleted", T.BooleanType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)
#: What generations hold; the generation itself is known from the manifest.
STORED = T.StructType([f for f in LOG.fields if f.name != "gen"])
LIVE = T.StructType([LOG["series_id"], LOG["ts"], LOG["value"]])
KEY = ["series_id", "ts"]


class InvalidRows(ValueError):
    """Rows that break the log's rules."""


def canonical(df: DataFrame) -> DataFrame:
    """``df`` with the stored columns alone, cast; a string value becomes its UTF-8 bytes."""
    missing = [f.name for f in STORED if f.name not in df.columns]
    if missing:
        raise InvalidRows(f"missing columns: {', '.join(missing)}")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in STORED])


def broken() -> Column:
    """True for rows that no log may hold: null keys, negative series, a live row without value or a tombstone with one."""
    nulls = F.col("series_id").isNull() | F.col("ts").isNull() | F.col("seq").isNull() | F.col("deleted").isNull()
    return nulls | (F.col("series_id") < 0) | (F.col("deleted") == F.col("value").isNotNull())


def checked(df: DataFrame) -> DataFrame:
    """``df``, failing the job at the first broken row; no extra pass is needed."""
    message = F.concat(F.lit("broken log row: "), F.to_json(F.struct("series_id", "ts", "seq", "deleted")))
    guard = F.when(broken(), F.raise_error(message).cast("boolean")).otherwise(F.col("deleted"))
    return df.withColumn("deleted", guard)
