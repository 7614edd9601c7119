"""What the two vector searches share: valid vectors, classes of equal vectors, and grouping of blocks.

Equal vectors have equal scores against anything, so a class needs no more than its ``k + 1`` smallest ids: the
window that keeps them is limited on the map side, and a vector that a third of all rows share is one class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pick


def valid(df: DataFrame, id_col: str, vector_col: str, *, zero_allowed: bool) -> DataFrame:
    """(vec_id, v) of rows with an id and a non-empty vector of finite numbers; v holds doubles."""
    rows = pick(df, vec_id=id_col, v=vector_col).selectExpr("CAST(vec_id AS LONG) AS vec_id", "CAST(v AS ARRAY<DOUBLE>) AS v")
    good = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if not zero_allowed:
        good &= F.exists("v", lambda x: x != 0)
    return rows.where(good)


def classes(rows: DataFrame, ids: int) -> DataFrame:
    """(uid, v, ids): each different vector once, with its smallest ids in order; uid is the first of them."""
    w = Window.partitionBy("v").orderBy("vec_id")
    first = rows.dropDuplicates(["vec_id", "v"]).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= ids)
    found = first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return found.select(F.col("ids")[0].alias("uid"), "v", "ids")


def expand(hits: DataFrame, found: DataFrame, queries: DataFrame, k: int, nearest_first: bool) -> DataFrame:
    """From (quid, uid, score) of classes to (query_id, rank, vec_id, score) of rows.

    hits: for each class of query vectors its best ``k + 1`` classes or more. queries: (query_id, quid).
    """
    order = F.col("score").asc() if nearest_first else F.col("score").desc()
    by_class = Window.partitionBy("quid").orderBy(order, "uid")
    best = hits.withColumn("rn", F.row_number().over(by_class)).where(F.col("rn") <= k + 1).drop("rn")
    rows = best.join(found.select("uid", "ids"), "uid").select("quid", "score", F.explode("ids").alias("vec_id"))
    by_row = Window.partitionBy("quid").orderBy(order, "vec_id")
    rows = rows.withColumn("rn", F.row_number().over(by_row)).where(F.col("rn") <= k + 1).drop("rn")
    # k + 1 rows serve every query with this vector: a query leaves itself out
    lists = rows.groupBy("quid").agg(F.collect_list(F.struct("score", "vec_id")).alias("hits"))
    sign = 1 if nearest_first else -1
    mine = F.filter("hits", lambda h: h["vec_id"] != F.col("query_id"))
    ordered = F.array_sort(F.transform(mine, lambda h: F.struct((sign * h["score"]).alias("key"), h["vec_id"].alias("vec_id"), h["score"].alias("score"))))
    top = F.slice(ordered, 1, k)
    out = queries.join(lists, "quid").select("query_id", F.posexplode(top).alias("pos", "h"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"), F.col("h.score").alias("score"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long number lists as a matrix."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks)
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1) if len(a) else np.empty((0, 0))


def sample_matrix(df: DataFrame, column: str, most: int) -> np.ndarray:
    """At most ``most`` vectors, chosen by their hash, on the driver."""
    rows = df.select(column).orderBy(F.xxhash64(column), column).limit(most).collect()
    return np.array([r[0] for r in rows], np.float64)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centers)
        for i in range(len(centers)):
            own = x[near == i]
            centers[i] = own.mean(axis=0) if len(own) else x[rng.integers(len(x))]
    return centers


#: Entries of a matrix of distances at a time, 32 MB.
ENTRIES = 1 << 22


def chunks(rows: int, columns: int) -> list[slice]:
    """Slices of ``rows`` such that each with ``columns`` has a bounded number of entries."""
    step = max(1, ENTRIES // max(1, columns))
    return [slice(i, min(rows, i + step)) for i in range(0, rows, step)]


def nearest(x: np.ndarray, centers: np.ndarray, n: int = 1) -> np.ndarray:
    """Index of the nearest center of each row; with n over 1 the n nearest, nearest first."""
    square, out = (centers * centers).sum(axis=1)[None, :], [np.empty((0,) if n == 1 else (0, n), np.int64)]
    for part in chunks(len(x), len(centers)):
        d = square - 2 * (x[part] @ centers.T)
        out.append(d.argmin(axis=1) if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n])
    return np.concatenate(out)


def deal(items: DataFrame, asks: DataFrame, key: list[str], most_items: int, most_asks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a search in blocks, with columns ``part`` and ``block`` beside the key.

    A group of more than ``most_items`` rows or ``most_asks`` questions is cut by hash; each cut of one side meets
    each of the other, so a task gets a bounded number of both. The table of groups is as small as the index's lists.
    """
    parts = items.groupBy(*key).agg(F.ceil(F.count("*") / most_items).cast("int").alias("parts"))
    blocks = asks.groupBy(*key).agg(F.ceil(F.count("*") / most_asks).cast("int").alias("blocks"))
    cuts = F.broadcast(parts.join(blocks, key))  # one row for each list of the index
    left = items.join(cuts, key).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = asks.join(cuts, key).withColumn("block", F.pmod(F.xxhash64("quid"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return left.drop("parts", "blocks"), right.drop("parts", "blocks")
