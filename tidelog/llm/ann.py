"""Approximate nearest neighbours by an adaptive scan of dimensions within inverted lists.

Lists come from k-means on a bounded sample; every vector goes to the list of its nearest center, and a query probes
a share of the lists. Vectors are turned by a random rotation, after which any columns are a fair sample of
all: scanning in blocks of columns, a candidate is abandoned as soon as its partial distance, scaled to all columns,
exceeds the current k-th distance by more than the test's margin. A query's nearest lists come first; the distance found
there is carried to its other lists and tightens as the scan goes. Survivors are scored on the original vectors.

Results by case: rows whose id or vector is null, whose vector is empty, zero or holds null or non-finite numbers take
no part; equal vectors are ranked by id; a row repeated with the same id and vector counts once; fewer candidates than
k give as many rows as there are; vectors of a length other than the commonest take no part; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import chunks, classes, deal, expand, k_means, matrix, nearest, sample_matrix, valid

#: Vectors on the driver for centers and rotation.
SAMPLE = 20_000
#: Columns between two tests.
COLUMNS = 16
#: Margin of the test: a larger one abandons later and errs less.
MARGIN = 2.1
#: Items between two tightenings of the limit.
SLAB = 512
HITS = "quid long, uid long, score double"
_HITS = pa.schema([("quid", pa.int64()), ("uid", pa.int64()), ("score", pa.float64())])


def scan(items: np.ndarray, turned: np.ndarray, queries: np.ndarray, asked: np.ndarray, limits: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query, positions and exact distances of its best k items, by adaptive scanning.

    turned, asked: items and queries rotated. limits: the distance to beat that a query brings along, or infinity; what has
    been found tightens it from one slab of items to the next.
    """
    d = items.shape[1]
    edges = [*range(0, d, COLUMNS), d]
    out = []
    for q, original, limit in zip(asked, queries, limits, strict=True):
        at, scores, end = [np.empty(0, np.int64)], np.empty(0), 0
        while end < len(items):
            begin, end = end, min(len(items), end + (SLAB if np.isfinite(limit) else 4 * k))
            alive, partial = np.arange(begin, end), np.zeros(end - begin)
            for a, b in zip(edges, edges[1:], strict=False):
                step = turned[alive, a:b] - q[a:b]
                partial = partial + np.einsum("ij,ij->i", step, step)
                if np.isfinite(limit):
                    keep = partial <= limit**2 * (b / d) * (1 + (MARGIN / math.sqrt(b) if b < d else 1e-4)) ** 2 + 1e-12
                    alive, partial = alive[keep], partial[keep]
                    if not len(alive):
                        break
            if len(alive):
                at.append(alive)
                scores = np.concatenate([scores, np.sqrt(((items[alive] - original) ** 2).sum(axis=1))])
                if len(scores) >= k:
                    limit = min(limit, float(np.partition(scores, k - 1)[k - 1]))
        where = np.concatenate(at)
        best = scores <= limit
        out.append((where[best], scores[best]))
    return out


def search(df: DataFrame, *, every: int = 100, k: int = 10, probe_share: float = 0.6, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 4096, asks: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row whose id is divisible by ``every``.

    probe_share: of the lists that a query looks into, at least 16. Vectors without clusters, as in the test tables, need
    more than half of the lists for a recall of 0.95; clustered ones need few.
    """
    rows = materialize(valid(df, id_col, vector_col, zero_allowed=False), "vectors")
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = size[0].d if size else 0
    rows = rows.where(F.size("v") == d)
    found = materialize(classes(rows, k + 1), "classes")
    n = found.count()
    if not n:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = int(min(4096, max(1, round(math.sqrt(n)))))
    probe = min(lists, max(16, math.ceil(lists * probe_share)))
    leading = min(probe, math.ceil(2 * (k + 1) * lists / n))  # lists of the first wave, which gives a limit
    sample = sample_matrix(found, "v", SAMPLE)
    centers = k_means(sample, lists)
    rotation = np.linalg.qr(np.random.default_rng(11).normal(size=(d, d)))[0]

    def rotated(x: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * d), pa.array((x @ rotation).astype(np.float32).reshape(-1)))

    def index(batches):
        for b in batches:
            x = matrix(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), rotated(x), pa.array(nearest(x, centers).astype(np.int32))], names=["uid", "v", "t", "list"])

    def ask(batches, begin: int, end: int):
        """Queries with their lists from ``begin`` to ``end``, nearest first; slices are bounded in rows."""
        for whole in batches:
            for part in chunks(whole.num_rows, max(len(centers), 16 * d * (end - begin))):
                b = whole.slice(part.start, part.stop - part.start)
                x = matrix(b.column(1))
                near = (nearest(x, centers, end) if end > 1 else nearest(x, centers)[:, None])[:, begin:end]
                at = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
                columns = [b.column(0).take(at), b.column(1).take(at), rotated(x).take(at), b.column(2).take(at), pa.array(near.reshape(-1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["quid", "q", "qt", "far", "list"])

    def block_search(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _HITS.empty_table()
        uids, quids = left["uid"].to_numpy(), right["quid"].to_numpy()
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        hits = scan(matrix(left["v"]), matrix(left["t"]), matrix(right["q"]), matrix(right["qt"]), right["far"].to_numpy(), k + 1)
        for quid, (at, score) in zip(quids, hits, strict=True):
            order = np.lexsort((uids[at], score))[: k + 1]
            best.append((np.full(len(order), quid), uids[at][order], score[order]))
        return pa.table([np.concatenate(c) for c in zip(*best, strict=True)], schema=_HITS)

    of_class = rows.where(F.col("vec_id") % every == 0).join(found.select("v", F.col("uid").alias("quid")), "v")
    queries = materialize(of_class.select(F.col("vec_id").alias("query_id"), "quid").distinct(), "queries")
    asked = found.join(queries.select(F.col("quid").alias("uid")).distinct(), "uid", "left_semi").select("uid", "v")
    items = materialize(found.select("uid", "v").mapInArrow(index, "uid long, v array<double>, t array<float>, list int"), "lists")
    keys = ["list", "part", "block"]

    def visit(those: DataFrame, begin: int, end: int) -> DataFrame:
        asking = those.mapInArrow(lambda b: ask(b, begin, end), "quid long, q array<double>, qt array<float>, far double, list int")
        left, right = deal(items, materialize(asking, "asking"), ["list"], block, asks)
        return materialize(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block_search, HITS), "hits")

    hits = visit(asked.withColumn("far", F.lit(float("inf"))), 0, leading)
    if leading < probe:
        # the (k + 1)-th distance found goes along to the other lists, where most candidates are abandoned after a few columns
        s = F.sort_array(F.collect_list("score"))
        limits = hits.groupBy("quid").agg(s.alias("s")).select(F.col("quid").alias("uid"), F.try_element_at("s", F.lit(k + 1)).alias("far"))
        known = asked.join(limits, "uid", "left").select("uid", "v", F.coalesce("far", F.lit(float("inf"))).alias("far"))
        hits = hits.union(visit(known, leading, probe))
    return expand(hits, found, queries, k, nearest_first=True)
