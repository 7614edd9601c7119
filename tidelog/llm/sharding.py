"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Every shard owns ``vnodes`` points of a 32-bit ring. A row's key hashes to a position and goes to the shard of the
first point clockwise; a full shard passes it on clockwise to the next shard that has room. Rows are taken in ring
order, so all rows between two points (an *arc*) share one order of preference and the whole decision can be made
on row counts: ``shards * vnodes`` arcs give a table whose size does not depend on the data. It says which ranks
of which arc go to which shard; rows find their shard by one broadcast join with that table.

Rank within an arc needs no long sort: the ring is divided into ``cells`` as well, their counts give the rank of a
cell's first row, and a window over each small cell gives the rest. Equal rows are counted before the shuffle and
expanded afterwards, so thousands of repeats of one row are one row on the way.

Results by case: null and empty texts are rows like any other (size 1); a null id hashes as an empty one; repeated
rows each get a slot of their own; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize, pick

RING = 1 << 32


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, in ring order; a shard's points do not depend on how many there are."""
    points = {}
    for s in range(shards):
        for v in range(vnodes):
            at = int(hashlib.md5(f"shard-{s}-{v}".encode()).hexdigest()[:8], 16)
            points[at] = min(s, points.get(at, s))
    return sorted(points.items())


def capacities(total: int, shards: int, epsilon: float) -> list[int]:
    """Rows that each shard takes at most. epsilon 0: counts at most one apart, and all of them fill up."""
    if epsilon <= 0:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [max(1, math.ceil(total * (1 + epsilon) / shards))] * shards


def quotas(counts: dict[int, int], points: list[tuple[int, int]], caps: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, slot of the first rank): rows of each arc dealt clockwise to shards with room.

    Arc ``a`` holds the positions up to and including ``points[a]``; positions past the last point belong to arc 0.
    """
    used = [0] * len(caps)
    full = {s for s, c in enumerate(caps) if c == 0}
    out = []
    for arc in sorted(counts):
        left, rank, at = counts[arc], 0, arc
        while left:
            s = points[at % len(points)][1]
            at += 1
            if s in full:
                if len(full) == len(caps):
                    raise ValueError("the shards' capacities are below the number of rows")
                continue
            n = min(left, caps[s] - used[s])
            out.append((arc, rank, rank + n, s, used[s]))
            used[s] += n
            rank += n
            left -= n
            if used[s] == caps[s]:
                full.add(s)
    return out


def bounded_ring(
    df: DataFrame, shards: int = 16, *, vnodes: int = 64, epsilon: float = 0.0, cells: int = 16384, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard) of every row of ``df``.

    epsilon is the slack over the mean load: 0 makes counts at most one apart, more moves fewer rows when shards are
    added. What the driver sees are counts of ``cells`` and arcs only.
    """
    spark = df.sparkSession
    points = ring_points(shards, vnodes)
    ends = [p for p, _ in points]
    rows = pick(df, doc_id=id_col, text=text_col).select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text")).cast("long").alias("bytes"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "bytes").cast("binary"))
    rows = rows.withColumn("pos", F.conv(F.substring(key, 1, 8), 16, 10).cast("long"))
    width = RING // cells
    # a cell is cut where an arc ends inside it, so that each (cell, arc) is wholly in one arc
    edges = spark.createDataFrame(_pieces(ends, width), "cell long, lo long, hi long, arc int")
    rows = rows.withColumn("cell", F.floor(F.col("pos") / width).cast("long"))
    grouped = materialize(rows.groupBy("doc_id", "bytes", "text_crc32", "pos", "cell").agg(F.count("*").alias("copies")), "ring")
    placed = grouped.join(F.broadcast(edges), (grouped.cell == edges.cell) & (grouped.pos >= edges.lo) & (grouped.pos < edges.hi)).drop(edges.cell)
    per_piece = placed.groupBy("arc", "lo").agg(F.sum("copies").alias("n")).collect()  # at most cells + arcs rows
    first, counts = [], {}
    for r in sorted(per_piece, key=lambda r: (r.arc, (r.lo - ends[r.arc - 1]) % RING)):  # clockwise; arc 0 wraps round
        first.append((r.lo, counts.get(r.arc, 0)))
        counts[r.arc] = counts.get(r.arc, 0) + r.n
    dealt = quotas(counts, points, capacities(sum(counts.values()), shards, epsilon))
    starts = spark.createDataFrame(first, "lo long, base long")
    deal = spark.createDataFrame(dealt, "q_arc int, q_from long, q_to long, shard int, q_slot long")
    w = Window.partitionBy("cell", "lo").orderBy("pos", "doc_id", "text_crc32", "bytes").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(F.broadcast(starts), "lo").withColumn("rank", F.col("base") + F.coalesce(F.sum("copies").over(w), F.lit(0)))
    hit = ranked.join(F.broadcast(deal), (F.col("arc") == F.col("q_arc")) & (F.col("rank") < F.col("q_to")) & (F.col("rank") + F.col("copies") > F.col("q_from")))
    lo, hi = F.greatest("rank", "q_from"), F.least(F.col("rank") + F.col("copies"), F.col("q_to"))
    slots = F.sequence(F.col("q_slot") + lo - F.col("q_from"), F.col("q_slot") + hi - F.col("q_from") - 1)
    return hit.select("doc_id", (F.col("bytes") + 1).alias("size"), "text_crc32", F.col("shard").cast(T.IntegerType()).alias("shard"), F.explode(slots).alias("slot"))


def _pieces(ends: list[int], width: int) -> list[tuple[int, int, int, int]]:
    """(cell, lo, hi, arc): the ring cut at every cell's and every arc's border."""
    cuts = sorted({*range(0, RING, width), *(e + 1 for e in ends if e + 1 < RING)}) + [RING]
    return [(lo // width, lo, hi, bisect_left(ends, lo) % len(ends)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
