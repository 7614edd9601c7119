"""What a reader can know of generations without their rows: footers, candidates of a lookup, read amplification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEY


def generation_footers(log: DataFrame) -> DataFrame:
    """Per generation: entries, distinct series, smallest and largest key, tombstones."""
    low, high = F.min(F.struct(*KEY)).alias("low"), F.max(F.struct(*KEY)).alias("high")
    found = log.groupBy("gen").agg(F.count("*").alias("entries"), F.countDistinct("series_id").alias("series"), low, high, F.sum(F.col("deleted").cast("long")).alias("tombstones"))
    return found.select(
        "gen", "entries", "series", F.col("low.series_id").alias("min_series"), F.col("low.ts").alias("min_ts"), F.col("high.series_id").alias("max_series"), F.col("high.ts").alias("max_ts"), "tombstones"
    )


def generation_candidates(log: DataFrame, series_id: int) -> DataFrame:
    """Generations that hold a series: the exact set; a Bloom filter may only add to it."""
    return log.where(F.col("series_id") == series_id).select("gen").distinct()


def read_amplification(log: DataFrame) -> DataFrame:
    """Per key, how many generations hold it."""
    return log.groupBy(*KEY).agg(F.countDistinct("gen").alias("generations"))
