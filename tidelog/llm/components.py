"""Connected components of graphs of edges, by smallest labels and pointer jumping, without leaving DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, comp) of every node of the edges (a, b); comp is the smallest node that can be reached.

    Each round takes the smallest label of the neighbours and then the label of that label. Every round is a scratch
    table of one row per node; nothing but a count goes to the driver.
    """
    keep = scratch or Scratch()
    both = keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    table = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp"), F.lit(True).alias("moved")), "labels")
    while table.where("moved").limit(1).count():
        labels = table.select("node", "comp")
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("m"))
        step = keep(labels.join(near, F.col("node") == F.col("a")).select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp")), "step")
        jump = step.select(F.col("node").alias("at"), F.col("comp").alias("to"))
        new = keep(step.join(jump, F.col("comp") == F.col("at")).select("node", F.col("to").alias("comp"), (F.col("to") != F.col("old")).alias("moved")), "labels")
        keep.drop(table, step)
        table = new
    keep.drop(both)
    return table.select("node", "comp")
