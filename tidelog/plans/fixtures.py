"""Change logs made of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000_000
#: Recency of lineitem rows: fewer columns leave ties.
LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def micros(c: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, read as UTC whatever the session's zone."""
    t = F.col(c).cast("timestamp_ntz")
    seconds = F.extract(F.lit("SECOND"), t)  # with its fraction
    return F.unix_date(t.cast("date")).cast("long") * DAY + F.hour(t).cast("long") * 3_600_000_000 + F.minute(t).cast("long") * 60_000_000 + (seconds * 1_000_000).cast("long")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per user, one key per day: many overwrites and tombstones; 250 events a generation."""
    gone = F.col("event_type") == "error"
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("series_id"),
        (micros("ts") - F.pmod(micros("ts"), F.lit(DAY))).alias("ts"),
        F.col("event_id").alias("seq"),
        F.expr("event_id div 250").alias("gen"),
        gone.alias("deleted"),
        F.when(~gone, F.col("props")).cast("binary").alias("value"),
    )


def lineitem_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per supplier, keyed by ship date; recency is a struct of four columns."""
    gone = F.col("l_returnflag") == "R"
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("series_id"), micros("l_shipdate").alias("ts"), F.struct(*LINEITEM_ORDER).alias("seq"), gone.alias("deleted"), F.when(~gone, F.col("l_linestatus")).cast("binary").alias("value")
    )


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per customer, keyed by order date: few overwrites."""
    gone = F.col("o_orderstatus") == "F"
    return _table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("series_id"), micros("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"), gone.alias("deleted"), F.when(~gone, F.col("o_orderpriority")).cast("binary").alias("value")
    )


def conversations_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per conversation, keyed by turn: no overwrites."""
    return _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("series_id"), F.col("turn").alias("ts"), F.col("turn").alias("seq"), F.lit(False).alias("deleted"), F.coalesce("text", F.lit("")).cast("binary").alias("value")
    )
