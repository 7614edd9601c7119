"""Last writer wins: the state of a log, point reads, range reads and compaction.

Everything rests on ``row_number() = 1`` over the key, newest first. Spark limits the window's groups before the shuffle
already, so a key that holds a third of all writes sends one row per task. Predicates on the key are pushed below the
window to the Parquet scan by the optimizer; predicates on ``value`` or ``deleted`` must stay above it, or an older
write would come back to life, so the functions here apply them last.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import KEY


def _recency(log: DataFrame, order: list[Column] | None) -> list[Column]:
    if order:
        return order
    return [F.col(c).desc() for c in ("gen", "seq") if c in log.columns]


def latest(log: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """The newest write of each key, tombstones included; ``order`` replaces (gen, seq) descending."""
    w = Window.partitionBy(*KEY).orderBy(*_recency(log, order))
    return log.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def live(log: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """(series_id, ts, value) of the keys whose newest write is not a tombstone."""
    return latest(log, order).where("NOT deleted").select(*KEY, "value")


def scan(log: DataFrame, series_id: int, start: int, end: int) -> DataFrame:
    """One series in a time range, both ends included, in time order. start > end is an empty range."""
    inside = log.where((F.col("series_id") == series_id) & F.col("ts").between(start, end))
    return live(inside).orderBy("ts")


def _status(found: Column, deleted: Column) -> Column:
    return F.when(~found, "miss").when(deleted, "tombstone").otherwise("live")


def get_status(log: DataFrame, keys: Iterable[tuple[int, int]]) -> DataFrame:
    """(series_id, ts, status, value) of a few given keys: live, tombstone or miss.

    The keys are literals, so they reach the scan as a filter.
    """
    keys = list(dict.fromkeys(keys))
    asked = log.sparkSession.createDataFrame(keys, "series_id long, ts long")
    wanted = F.lit(False)
    for s, t in keys:
        wanted |= (F.col("series_id") == s) & (F.col("ts") == t)
    return _look_up(F.broadcast(asked), latest(log.where(wanted)))  # as many rows as literals


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The same for a table of keys of any size; both sides meet by one shuffle on the key."""
    return _look_up(keys.select(*KEY).distinct(), latest(log))


def _look_up(asked: DataFrame, newest: DataFrame) -> DataFrame:
    found = newest.select(*KEY, "deleted", "value", F.lit(True).alias("_found"))
    status = _status(F.coalesce("_found", F.lit(False)), F.col("deleted"))
    return asked.join(found, KEY, "left").select(*KEY, status.alias("status"), F.when(status == "live", F.col("value")).alias("value"))


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The part of the log that was written up to ``seq``; the bound chooses history, so it lies below every rank."""
    return log.where(F.col("seq") <= seq)


def compact(log: DataFrame, major: bool = True) -> DataFrame:
    """The newest write of each key. A major compaction drops tombstones and may only take a log's whole history."""
    newest = latest(log)
    return newest.where("NOT deleted") if major else newest


def compact_stats(log: DataFrame) -> DataFrame:
    """Per series: rows read, rows shadowed by newer ones, tombstones left, rows that a major compaction keeps."""
    per_key = log.groupBy(*KEY).agg(F.count("*").alias("n"), F.max_by("deleted", F.struct(*[c for c in ("gen", "seq") if c in log.columns])).alias("gone"))
    return per_key.groupBy("series_id").agg(
        F.sum("n").alias("input_rows"),
        F.sum(F.col("n") - 1).alias("shadowed"),
        F.sum(F.col("gone").cast("long")).alias("tombstones"),
        F.sum((~F.col("gone")).cast("long")).alias("output_rows"),
    )


def replay_tail(log: DataFrame, flushed_gen: int) -> DataFrame:
    """State after replaying the generations past ``flushed_gen`` over a compacted base: tail wins, tombstones kept."""
    base = compact(log.where(F.col("gen") <= flushed_gen), major=False)
    tail = compact(log.where(F.col("gen") > flushed_gen), major=False)
    return latest(base.unionByName(tail))


def revived(log: DataFrame) -> DataFrame:
    """Keys with a write directly after a tombstone, and how often: an insert brings a deleted key back."""
    w = Window.partitionBy(*KEY).orderBy(*[F.col(c) for c in ("gen", "seq") if c in log.columns])
    before = log.withColumn("_before", F.lag("deleted").over(w))
    return before.where("_before AND NOT deleted").groupBy(*KEY).agg(F.count("*").alias("revivals"))
