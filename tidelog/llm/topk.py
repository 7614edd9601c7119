"""Exact top-k inner products of integer vectors by a pivot-distance index.

With M the largest norm, every vector x gets one more coordinate, sqrt(M^2 - |x|^2), and a query q a zero; then
``|q' - x'|^2 = |q|^2 + M^2 - 2 q.x``, so the largest products are the nearest neighbours. Each vector is keyed by its
nearest pivot and its distance r to it, and rings (*annuli*) of each pivot are blocks of the index. By the triangle
inequality no vector of an annulus [r0, r1] is nearer to a query at distance D from the pivot than
``max(0, D - r1, r0 - D)``. A query first searches the annulus with the smallest bound, which gives a k-th distance, and
then expands to those annuli alone whose bound does not exceed it; inside an annulus, sorted by r, only to the stretch from
``D - reach`` to ``D + reach``. Products are exact integers at any size: in doubles where these are exact, else in longs or in
Python's integers.

Results by case: rows whose id or vector is null or whose vector is empty or holds null or non-finite numbers take no part
(zero vectors do); a component whose multiple exceeds 2^62 counts as that, a product that exceeds a long as the largest or smallest
long; ties are ranked by id; a row repeated with the same id and vector counts once; fewer candidates
than k give as many rows as there are; vectors of a length other than the commonest take no part; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import chunks, classes, deal, expand, k_means, matrix, sample_matrix, valid

SAMPLE = 20_000
#: Components are cut at this size, products at a long's.
LARGEST, SATURATED = float(1 << 62), (1 << 63) - 1
HITS = "quid long, uid long, score long"
_HITS = pa.schema([("quid", pa.int64()), ("uid", pa.int64()), ("score", pa.int64())])


def lifted(x: np.ndarray, square: float, query: bool = False) -> np.ndarray:
    """Vectors with the coordinate that brings them to norm M (a zero for queries)."""
    x = x.astype(np.float64)
    more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, square - (x * x).sum(axis=1)))
    return np.c_[x, more]


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)))


def margin(square: float) -> float:
    """More than the rounding of lifted distances, which grows with the largest norm."""
    return 1e-6 * (1 + math.sqrt(square))


def bounds(to_pivot: np.ndarray, cells: np.ndarray, square: float = 0.0) -> np.ndarray:
    """(queries, cells) smallest possible distance; cells hold (pivot, ring, r0, r1). A little less, for rounding."""
    d = to_pivot[:, cells[:, 0].astype(int)]
    return np.maximum(0, np.maximum(d - cells[:, 3], cells[:, 2] - d)) * (1 - 1e-9) - margin(square)


def products(q: np.ndarray, x: np.ndarray, square: float) -> np.ndarray:
    """Exact inner products of whole-number vectors as longs, if no norm's square exceeds ``square``; beyond a long, saturated."""
    if square < 2**52:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if square < 2**62:
        return q @ x.T
    wide = q.astype(object) @ x.astype(object).T
    return np.clip(wide, -SATURATED, SATURATED).astype(np.int64)


def search(df: DataFrame, *, every: int = 20, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 4096, asks: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of floor(scale * x) for ids divisible by ``every``."""
    rows = valid(df, id_col, vector_col, zero_allowed=True)
    whole = lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-LARGEST)), F.lit(LARGEST))).cast("long")
    rows = materialize(rows.select("vec_id", F.transform("v", whole).alias("v")), "vectors")
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = rows.where(F.size("v") == (size[0].d if size else 0))
    found = materialize(classes(rows, k + 1), "classes")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, square = found.agg(F.count("*"), F.max(norm)).first()
    if not n:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = lifted(sample_matrix(found, "v", SAMPLE), square)
    pivots = k_means(sample, int(min(512, max(2, round(2 * math.sqrt(n / block))))))
    near = np.concatenate([distance(sample[part], pivots).min(axis=1) for part in chunks(len(sample), len(pivots))])
    rings = int(min(64, max(2, math.ceil(n / len(pivots) / block))))
    borders = np.quantile(near, np.linspace(0, 1, rings + 1)[1:-1])

    def index(batches):
        for whole_batch in batches:
            for part in chunks(whole_batch.num_rows, len(pivots)):
                b = whole_batch.slice(part.start, part.stop - part.start)
                d = distance(lifted(matrix(b.column(1)), square), pivots)
                p, r = d.argmin(axis=1), d.min(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p.astype(np.int32)), pa.array(np.searchsorted(borders, r).astype(np.int32)), pa.array(r)], names=["uid", "v", "pivot", "ring", "r"])

    items = materialize(found.select("uid", "v").mapInArrow(index, "uid long, v array<long>, pivot int, ring int, r double"), "annuli")
    stats = items.groupBy("pivot", "ring").agg(F.min("r").alias("r0"), F.max("r").alias("r1")).orderBy("pivot", "ring").collect()  # pivots * rings rows at most
    cells = np.array([(s.pivot, s.ring, s.r0, s.r1) for s in stats], np.float64)

    of_class = rows.where(F.col("vec_id") % every == 0).join(found.select("v", F.col("uid").alias("quid")), "v")
    queries = materialize(of_class.select(F.col("vec_id").alias("query_id"), "quid").distinct(), "queries")
    asked = found.join(queries.select(F.col("quid").alias("uid")).distinct(), "uid", "left_semi").select("uid", "v")

    def to_cells(batches, rest: bool):
        """Each query with the annulus of the smallest bound; or, with a limit known, with all others within it."""
        for whole_batch in batches:
            for part in chunks(whole_batch.num_rows, 16 * len(cells)):
                b = whole_batch.slice(part.start, part.stop - part.start)
                q = lifted(matrix(b.column(1)), square, query=True)
                to_pivot = distance(q, pivots)
                low = bounds(to_pivot, cells, square)
                first = np.zeros(low.shape, bool)
                first[np.arange(len(low)), low.argmin(axis=1)] = True
                if rest:
                    limit = b.column(2).to_numpy(zero_copy_only=False)
                    limit = np.where(np.isnan(limit), -np.inf, limit)
                    reach = np.sqrt(np.maximum(0, (q * q).sum(axis=1) + square - 2 * limit)) + margin(square)
                    take, cell = np.nonzero((low <= reach[:, None]) & ~first)
                else:
                    limit, reach = (np.full(len(q), x) for x in (-np.inf, np.inf))
                    take, cell = np.nonzero(first)
                at, pivot = pa.array(take), cells[cell, 0].astype(np.int32)
                columns = [b.column(0).take(at), b.column(1).take(at), pa.array(limit[take]), pa.array(reach[take]), pa.array(to_pivot[take, pivot]), pa.array(pivot), pa.array(cells[cell, 1].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["quid", "q", "least", "reach", "d", "pivot", "ring"])

    def block_search(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        """The annulus in order of distance to its pivot; queries read the stretch within their reach."""
        if not left.num_rows or not right.num_rows:
            return _HITS.empty_table()
        order = np.argsort(left["r"].to_numpy(), kind="stable")
        r, uids, vectors = left["r"].to_numpy()[order], left["uid"].to_numpy()[order], matrix(left["v"])[order]
        low, high = (np.searchsorted(r, right["d"].to_numpy() + sign * right["reach"].to_numpy(), side) for sign, side in ((-1, "left"), (1, "right")))
        lo, hi = int(low.min()), int(max(high.max(), low.min()))
        scored = products(matrix(right["q"]), vectors[lo:hi], square)
        out = []
        for quid, score, least, a, b in zip(right["quid"].to_numpy(), scored, right["least"].to_numpy(), low, high, strict=True):
            a, b = max(lo, int(a)), max(lo, int(b))
            score, ids = score[a - lo : b - lo], uids[a:b]
            floor = -SATURATED if least == -np.inf else int(max(-SATURATED, min(SATURATED, least - abs(least) * 1e-12 - 1)))
            if len(score) > k + 1:
                floor = max(floor, int(np.partition(score, len(score) - k - 1)[len(score) - k - 1]))
            at = np.flatnonzero(score >= floor)
            at = at[np.lexsort((ids[at], -score[at]))][: k + 1]
            out.append((np.full(len(at), quid), ids[at], score[at]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=_HITS)

    keys = ["pivot", "ring", "part", "block"]
    ask_ddl = "quid long, q array<long>, least double, reach double, d double, pivot int, ring int"

    def visit(asking: DataFrame) -> DataFrame:
        left, right = deal(items, materialize(asking, "asking"), ["pivot", "ring"], block, asks)
        return materialize(left.select("uid", "v", "r", *keys).groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block_search, HITS), "hits")

    near_hits = visit(asked.mapInArrow(lambda b: to_cells(b, False), ask_ddl))
    # the (k + 1)-th best so far; classes are different vectors, so at least so many rows are as good
    w = F.sort_array(F.collect_list("score"), asc=False)
    limits = near_hits.groupBy("quid").agg(w.alias("s")).select(F.col("quid").alias("uid"), F.when(F.size("s") > k, F.try_element_at("s", F.lit(k + 1))).cast("double").alias("limit"))
    known = asked.join(limits, "uid", "left").select("uid", "v", F.coalesce("limit", F.lit(float("nan"))).alias("limit"))
    far_hits = visit(known.mapInArrow(lambda b: to_cells(b, True), ask_ddl))
    return expand(near_hits.union(far_hits), found, queries, k, nearest_first=False)
