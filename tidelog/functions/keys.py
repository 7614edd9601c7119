"""Series ids of the full unsigned 64-bit range in signed longs, with their order kept.

By default ids must lie in 0 .. 2^63 - 1 and are stored as they are. A caller with larger ids shifts them all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = "CAST(9223372036854775808 AS DECIMAL(20,0))"


def from_unsigned(c: Column | str) -> Column:
    """An unsigned id (decimal or long) as a long, 2^63 less."""
    c = F.col(c) if isinstance(c, str) else c
    return (c.cast("decimal(20,0)") - F.expr(SHIFT)).cast("long")


def to_unsigned(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (c.cast("decimal(20,0)") + F.expr(SHIFT)).cast("decimal(20,0)")
