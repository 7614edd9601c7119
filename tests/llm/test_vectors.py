import math

import numpy as np
import pytest

from tidelog.llm import ann, queries, topk, vectors

SF = "/root/testdata/sf0.01"


def table(rows):
    return {int(i): np.array(v, np.float64) for i, v in rows}


@pytest.fixture(scope="module")
def embeddings(spark):
    return table((r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def best(items, q, k, score, nearest):
    rows = [(score(items[q], v) * (1 if nearest else -1), i) for i, v in items.items() if i != q]
    return sorted(rows)[:k]


def test_op6_recall_and_scores(spark, embeddings):
    got = by_query(queries.op6_ann(spark, SF).collect())
    distance = lambda a, b: float(np.sqrt(((a - b) ** 2).sum()))
    hits = total = 0
    assert set(got) == {i for i in embeddings if i % 100 == 0}
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, 11)) and q not in [v for _, v, _ in rows]
        assert all(abs(s - distance(embeddings[q], embeddings[v])) < 1e-9 for _, v, s in rows)
        assert [(s, v) for _, v, s in rows] == sorted((s, v) for _, v, s in rows)
        true = {i for _, i in best(embeddings, q, 10, distance, True)}
        hits += len(true & {v for _, v, _ in rows})
        total += 10
    assert hits / total >= 0.9


def test_op8_is_exact(spark, embeddings):
    items = {i: np.floor(64 * v).astype(np.int64) for i, v in embeddings.items()}
    got = by_query(queries.op8_topk(spark, SF).collect())
    assert set(got) == {i for i in items if i % 20 == 0}
    for q, rows in got.items():
        want = best(items, q, 20, lambda a, b: int(a @ b), False)
        assert [(v, s) for _, v, s in rows] == [(i, -s) for s, i in want]


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(1, 300)]
    rows += [(i, [1.0, 0.5, 0.25, 0.125]) for i in range(300, 420)]  # one very common vector
    rows += [(500, None), (501, []), (502, [1.0, None, 1.0, 1.0]), (503, [float("nan")] * 4), (504, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (505, [1.0]), (506, [0.0] * 4), (20, rows[19][1])]
    return rows, spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, uid string, score double").repartition(3)


def test_odd_rows_topk(odd):
    rows, df = odd
    items = {i: np.floor(64 * np.array(v, np.float32).astype(float)) for i, v in rows if i and v and len(v) == 4 and None not in v and np.isfinite(v).all()}
    for block, asks in ((4096, 1024), (16, 5)):
        got = by_query(topk.search(df, every=5, k=6, block=block, asks=asks).collect())
        assert set(got) == {i for i in items if i % 5 == 0}
        for q, found in got.items():
            assert [(v, s) for _, v, s in found] == [(i, -s) for s, i in best(items, q, 6, lambda a, b: int(a @ b), False)]
    assert topk.search(df.limit(0)).count() == 0
    few = by_query(topk.search(df.where("vec_id IN (1, 2, 20)"), every=20, k=6).collect())
    assert {q: len(v) for q, v in few.items()} == {20: 2}


def test_odd_rows_ann(odd):
    rows, df = odd
    items = {i: np.array(v, np.float32).astype(float) for i, v in rows if i and v and len(v) == 4 and None not in v and np.isfinite(v).all() and any(v)}
    distance = lambda a, b: float(np.sqrt(((a - b) ** 2).sum()))
    got = by_query(ann.search(df, every=5, k=6, probe_share=1.0, block=32, asks=7).collect())
    assert set(got) == {i for i in items if i % 5 == 0}
    same = sum([v for _, v, _ in found] == [i for _, i in best(items, q, 6, distance, True)] for q, found in got.items())
    assert same >= 0.9 * len(got)
    assert [v for _, v, _ in got[305]] == [300, 301, 302, 303, 304, 306]
    assert ann.search(df.limit(0)).count() == 0
    few = by_query(ann.search(df.where("vec_id IN (1, 2, 20)"), every=20, k=6).collect())
    assert {q: len(v) for q, v in few.items()} == {20: 2}


def test_adaptive_scan_abandons_early():
    rng = np.random.default_rng(0)
    items, queries_ = rng.normal(size=(3000, 64)), rng.normal(size=(20, 64))
    rotation = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    right = 0
    for q, (at, exact) in zip(queries_, ann.scan(items, items @ rotation, queries_, queries_ @ rotation, np.full(20, np.inf), 10), strict=True):
        assert len(at) < 200
        true = np.argsort(((items - q) ** 2).sum(axis=1))[:10]
        right += len(set(true) & set(at))
    assert right >= 190


def test_carried_limit_works_in_short_lists():
    """With a limit brought along, even a list of a few rows is tested, and nothing within the limit is lost."""
    rng = np.random.default_rng(2)
    items, queries_ = rng.normal(size=(30, 64)), rng.normal(size=(20, 64))
    exact = np.sqrt(((items[None] - queries_[:, None]) ** 2).sum(axis=2))
    limits = np.sort(exact, axis=1)[:, 4]
    for own, limit, (at, score) in zip(exact, limits, ann.scan(items, items, queries_, queries_, limits, 10), strict=True):
        assert (score <= limit).all() and len(at) <= 5 and np.allclose(own[at], score)


@pytest.mark.parametrize("size", [1.0, 1e6, 1e7, 1e9, 1e15, 1e300])
def test_topk_of_large_components_is_exact(spark, size):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * (size if i % 3 else 1.0)).tolist()) for i in range(1, 160)]
    cut = lambda x: max(-(1 << 62), min(1 << 62, math.floor(64 * x)))
    items = {i: [cut(x) for x in v] for i, v in rows}
    top = (1 << 63) - 1
    product = lambda a, b: max(-top, min(top, sum(x * y for x, y in zip(a, b, strict=True))))
    got = by_query(topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), every=20, k=7, block=32, asks=4).collect())
    assert set(got) == {i for i in items if i % 20 == 0}
    for q, found in got.items():
        want = sorted((-product(items[q], v), i) for i, v in items.items() if i != q)[:7]
        assert [(v, s) for _, v, s in found] == [(i, -s) for s, i in want]


def test_bound_never_exceeds_distance():
    rng = np.random.default_rng(6)
    x, q = rng.integers(-50, 50, (200, 8)).astype(float), rng.integers(-50, 50, (9, 8)).astype(float)
    square = (x * x).sum(axis=1).max()
    lifted, asked = topk.lifted(x, square), topk.lifted(q, square, query=True)
    pivots = lifted[:5]
    d = topk.distance(lifted, pivots)
    cells = np.array([(p, 0, d[i, p], d[i, p]) for i, p in enumerate(d.argmin(axis=1))])
    assert (topk.bounds(topk.distance(asked, pivots), cells) <= topk.distance(asked, lifted) + 1e-9).all()
    assert np.allclose(topk.distance(asked, lifted) ** 2, (q * q).sum(axis=1)[:, None] + square - 2 * (q @ x.T), atol=1e-5)


def test_nearest_and_k_means():
    x = np.r_[np.zeros((50, 2)), np.ones((50, 2)) * 9]
    assert sorted(vectors.k_means(x + 0.0, 2)[:, 0].round().tolist()) in ([0.0, 9.0], [0.0, 0.0], [9.0, 9.0])
    assert vectors.nearest(np.array([[1.0, 1.0]]), np.array([[9.0, 9.0], [0.0, 0.0]]), 2).tolist() == [[1, 0]]
