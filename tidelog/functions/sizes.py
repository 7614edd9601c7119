"""Bytes that a write takes in a write buffer, in a table block and in a write-ahead log.

Fixed values: what each format spends on a record besides its value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUFFER_LIVE, BUFFER_TOMBSTONE, TABLE_ENTRY, WAL_RECORD = 16, 17, 25, 29


def _length(value: Column | str) -> Column:
    return F.coalesce(F.octet_length(F.col(value) if isinstance(value, str) else value), F.lit(0)).cast("long")


def memtable_size(deleted: Column | str = "deleted", value: Column | str = "value") -> Column:
    d = F.col(deleted) if isinstance(deleted, str) else deleted
    return F.when(d, F.lit(BUFFER_TOMBSTONE).cast("long")).otherwise(BUFFER_LIVE + _length(value))


def table_size(value: Column | str = "value") -> Column:
    return TABLE_ENTRY + _length(value)


def wal_size(value: Column | str = "value") -> Column:
    return WAL_RECORD + _length(value)
