"""Chat formatting after collapsing cumulative snapshots of conversations.

A chat log often holds the same conversation many times, once after every turn. Each turn's prefix gets a rolling
128-bit hash (exclusive or of the hashes of (position, role, text) up to it, so it can be added up in parts). A
conversation is a snapshot if its full hash and length equal a prefix of a longer one; an anti-join drops those, and of
equal conversations the one with the smallest id stays. What remains is rendered turn by turn.

A conversation may be very long: positions come from counts of short stretches of turns, each within one range partition, so no task
sorts more than a stretch's rows at a time, and the rendered text is one row per ``segment`` turns.

Results by case: rows with a null conversation id take no part; null turns come first, ties of one turn are ordered by role and
text (nulls first) and repeated rows are turns of their own; a null role renders as ``unknown`` and a null text as
empty, though null and empty count as different turns; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, pick


def turn_hash(salt: int) -> Column:
    """Hash of a turn at its place; nulls are told apart from every value."""
    return F.xxhash64(F.lit(salt), "pos", F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))


def positions(turns: DataFrame, stretch: int) -> DataFrame:
    """``turns`` with pos, from 1 within each conversation, by (turn, role, text), and the stretch that it was placed in.

    A stretch is the part of ``stretch`` neighbouring turn numbers that lies in one range partition. Ranges are cut by conversation,
    turn, role and the beginning of the text, so neither a long conversation nor one turn number that repeats is one task's;
    equal rows are one row until they have their places.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first()]
    same = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    ranged = same.repartitionByRange(F.col("conv_id"), *order, F.substring("text", 1, 64).asc_nulls_first())
    cut = F.floor(F.coalesce(F.col("turn"), F.lit(-(1 << 40))) / stretch)
    ranged = materialize(ranged.withColumn("stretch", F.struct(cut.alias("cut"), F.spark_partition_id().alias("part"))), "ranges")
    counts = materialize(ranged.groupBy("conv_id", "stretch").agg(F.sum("copies").alias("n")), "stretches")
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("conv_id", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv_id", "stretch").orderBy(*order, F.col("text").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("rn", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(starts, ["conv_id", "stretch"])
    first = F.col("base") + F.col("rn")
    return placed.withColumn("pos", F.explode(F.sequence(first + 1, first + F.col("copies")))).drop("base", "rn", "copies")


def render(role: str = "role", text: str = "text") -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def collapse(df: DataFrame, *, stretch: int = 256, segment: int = 1024, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, segment, n_turns (of the conversation) and rendered text of every maximal conversation."""
    turns = pick(df, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv_id IS NOT NULL")
    placed = positions(turns, stretch).withColumn("h1", turn_hash(1)).withColumn("h2", turn_hash(2))
    placed = materialize(placed, "turns")
    # hashes of prefixes: within a stretch, and of all stretches before it
    parts = placed.groupBy("conv_id", "stretch").agg(F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2"), F.count("*").alias("n"))
    parts = materialize(parts, "parts")
    up_to = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("conv_id", "stretch", *(F.coalesce(F.bit_xor(f"s{i}").over(up_to), F.lit(0)).alias(f"b{i}") for i in (1, 2)))
    whole = materialize(parts.groupBy("conv_id").agg(F.bit_xor("s1").alias("h1"), F.bit_xor("s2").alias("h2"), F.sum("n").alias("n_turns")), "whole")
    rolling = Window.partitionBy("conv_id", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    prefixes = placed.select("conv_id", "stretch", "pos", *(F.bit_xor(f"h{i}").over(rolling).alias(f"p{i}") for i in (1, 2)))
    prefixes = prefixes.join(base, ["conv_id", "stretch"]).select("conv_id", "pos", *(F.col(f"p{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"p{i}") for i in (1, 2)))
    proper = prefixes.join(whole.select("conv_id", "n_turns"), "conv_id").where("pos < n_turns").select("pos", "p1", "p2").distinct()
    proper = materialize(proper, "prefixes")
    one = whole.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    kept = one.join(proper, (one.n_turns == proper.pos) & (one.h1 == proper.p1) & (one.h2 == proper.p2), "left_anti").select("conv_id", "n_turns")
    kept = materialize(kept, "kept")
    lines = placed.join(kept, "conv_id").select("conv_id", "n_turns", F.floor((F.col("pos") - 1) / segment).cast("int").alias("segment"), "pos", render().alias("line"))
    texts = lines.groupBy("conv_id", "segment", "n_turns").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return texts.select("conv_id", "segment", "n_turns", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))


ORACLE = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
         md5(concat_ws('|', coalesce('r' || role, 'n'), coalesce('t' || text, 'n'))) AS h,
         '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, pos, string_agg(h, ',') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix,
             count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t),
w AS (SELECT min(conv_id) AS conv_id, n_turns, prefix FROM p WHERE pos = n_turns GROUP BY n_turns, prefix),
k AS (SELECT conv_id, n_turns FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n_turns AND p.prefix = w.prefix))
SELECT k.conv_id, CAST((t.pos - 1) // 1024 AS INTEGER) AS segment, k.n_turns, string_agg(t.line, '' ORDER BY t.pos) AS rendered
FROM k JOIN t USING (conv_id) GROUP BY 1, 2, 3
"""
