import random
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import common, minhash, queries
from tidelog.llm.components import components


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, threshold=80):
    """(n_shingles, component) by row, over exact sets: pairs that share a rare shingle of their prefix, all confirmed."""
    sets = [shingles(t, k) for _, t in rows]
    counts = Counter(s for x in sets for s in x)
    index, parent = defaultdict(list), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        prefix = sorted(x, key=lambda s: (counts[s], s))[: len(x) - -(-threshold * len(x) // 100) + 1]
        for j in {j for s in prefix for j in index[s]}:
            both = len(x & sets[j])
            if 100 * both >= threshold * (len(x) + len(sets[j]) - both):
                parent[root(i)] = root(j)
        for s in prefix:
            index[s].append(i)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[root(i)] = min(doc_id, low.get(root(i), doc_id))
    return [(len(x), low.get(root(i)) if x else rows[i][0]) for i, x in enumerate(sets)]


def test_op10_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want = {d: v for (d, _), v in zip(rows, brute(rows, 4), strict=True)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op10_minhash(spark, "/root/testdata/sf0.01").collect()}
    assert got == want and sum(d != c for d, (_, c) in want.items()) > 20


def edited(rng, words, share):
    return [w if rng.random() > share else f"e{rng.randrange(10**9)}" for w in words]


@pytest.fixture(scope="module")
def planted():
    """Groups whose members differ from their base and from each other to many degrees, one of them large."""
    rng = random.Random(4)
    rows = []
    for size in [2] * 25 + [12] * 4 + [150]:
        base = [f"w{rng.randrange(10**9)}" for _ in range(rng.randint(30, 160))]
        rows += [" ".join(edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05]))) for _ in range(size)]
    rows += ["", " \n\t ", "one", "one", "two words", "Two Words", "a b c", *["same text of some words here now"] * 40]
    rng.shuffle(rows)
    return [*enumerate(rows), (None, "same text of some words here now"), (None, "only without an id at all"), (7, None), (7, "seven has another text too here"), (7, None)]


def test_planted_groups(spark, planted):
    df = spark.createDataFrame(planted, "doc_id long, text string").repartition(5)
    for k in (4, 5):
        want = Counter((d, *v) for (d, _), v in zip(planted, brute(planted, k), strict=True))
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, shingle=k).collect())
        assert got == want


def test_large_mixed_buckets_are_salted(spark, planted, monkeypatch):
    """Small homes and blocks, few homes at all, and a bitmap so full that it lets nearly every row pass."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "HOME", 5)
    monkeypatch.setattr(minhash, "HUB_BANDS", 30)
    monkeypatch.setattr(common, "BITMAP", 64)
    df = spark.createDataFrame(planted, "doc_id long, text string")
    want = Counter((d, *v) for (d, _), v in zip(planted, brute(planted, 4), strict=True))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, shingle=4).collect()) == want


def test_keep_one(spark, planted):
    rows = [(d, t, f"c{d}") for d, t in planted if d is not None and d != 7]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls string")
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    want = {d for (d, _), (_, c) in zip([r[:2] for r in rows], brute([r[:2] for r in rows], 5), strict=True) if d == c}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    repeated = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "other", "z"), (None, "nothing else", "n")], df.schema)
    assert sorted(((r.doc_id, r.text) for r in minhash.keep_one(repeated).collect()), key=str) == [(1, "a b c d e f"), (3, "other"), (None, "nothing else")]


def test_keep_one_decides_by_row(spark, planted):
    """Ids that name several texts, null ids, exactly equal rows: every group keeps one row, and every text without words stays."""
    base = [f"w{i}" for i in range(60)]
    a, b, c = (" ".join(f"{x}{w}" for w in base) for x in "abc")
    rows = [(5, a), (7, a + " more"), (3, b), (5, b + " more"), (5, "  "), (5, "  "), (7, None), (None, c), (None, c + " more"), (None, c), (None, "alone"), (9, "twice"), (9, "twice"), (8, "near")]
    rows += [(4, "one two"), (4, "One  Two"), *[(d if d is None or d % 3 else 2, t) for d, t in planted]]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, other string").repartition(4)
    got = Counter((r.doc_id, r.text) for r in minhash.keep_one(df).collect())
    assert got[5, a] == got[3, b] == got[None, "alone"] == got[9, "twice"] == 1 and got[5, "  "] == 2 and got[7, None] == 3
    assert not got[7, a + " more"] and not got[5, b + " more"] and got[None, c] + got[None, c + " more"] == 1
    sets = [shingles(t, 5) for _, t in rows]
    groups, members = groups_of(sets), defaultdict(list)
    for g, x, row in zip(groups, sets, rows, strict=True):
        if x:
            members[g].append(row)
    assert sum(got.values()) == len(members) + sum(not x for x in sets)
    for those in members.values():
        least = min((d for d, _ in those if d is not None), default=None)
        assert any(got[d, t] for d, t in those if d == least)


def groups_of(sets, threshold=80):
    """A group number for each set, over all pairs."""
    group = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and group[i] != group[j] and 100 * both >= threshold * (len(x) + len(sets[j]) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x", 1, 2, 3)], "doc_id long, text string, n_shingles int, component_id int, key int")
    assert [tuple(r) for r in minhash.near_duplicates(df).collect()] == [(1, 1, 1, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0 and minhash.keep_one(df.limit(0)).count() == 0


def test_estimate_is_collision_corrected():
    rng = np.random.default_rng(1)
    for share in (0.0, 0.5, 0.9):
        a = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
        n = int(len(a) * share)
        b = np.unique(np.r_[a[:n], rng.integers(0, 1 << 63, len(a) - n, dtype=np.uint64)])
        x, y = minhash.pack(np.stack([minhash.minima(a), minhash.minima(b)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(float(minhash.similarity(x, y)) - true) < minhash.SLACK


def test_estimate_holds_in_small_sets():
    """At similarity 0.8 exactly, where every pair must reach the check on full sets."""
    rng = np.random.default_rng(5)
    for less, more, both in ((4, 5, 4), (8, 10, 8), (9, 9, 8)):
        errors = []
        for _ in range(1500):
            x = rng.integers(0, 1 << 63, less + more - both, dtype=np.uint64)
            a, b = minhash.pack(np.stack([minhash.minima(x[:less]), minhash.minima(x[len(x) - more :])]))
            errors.append(float(minhash.similarity(a, b)) - 0.8)
        assert min(errors) > -minhash.SLACK and np.std(errors) < 0.02, (less, more, min(errors), np.std(errors))


def variants(rng, base, size, edits):
    """Texts that each differ from the base in ``edits`` places of their own."""
    out = []
    for _ in range(size):
        words = list(base)
        for at in rng.sample(range(len(base)), edits):
            words[at] = f"v{rng.randrange(10**12)}"
        out.append(" ".join(words))
    return out


def test_large_groups_stay_linear(spark, monkeypatch):
    """3,000 texts alike below the threshold, and 3,000 above: links are right and no step gives more rows than it reads."""
    rng = random.Random(9)
    base, other = ([f"{x}{rng.randrange(10**9)}" for _ in range(200)] for x in "ab")
    texts = variants(rng, base, 3000, 4) + variants(rng, other, 3000, 2)
    rows = list(enumerate(texts))
    made = []
    real = minhash.Scratch.__call__
    monkeypatch.setattr(minhash.Scratch, "__call__", lambda self, df, name: made.append((name, t := real(self, df, name), t.count())) or t)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, shingle=4).collect()}
    pairs = [jaccard(texts[i], texts[j], 4) for i, j in ((rng.randrange(3000), rng.randrange(3000)) for _ in range(500)) if i != j]
    assert sorted(pairs)[5] > 0.69 and sum(x < 0.8 for x in pairs) > 400
    assert {c for i, (_, c) in got.items() if i >= 3000} == {3000}
    want = by_products(texts[:3000], 4)
    assert {i: v for i, v in got.items() if i < 3000} == dict(enumerate(want)) and len({c for _, c in want}) > 300
    sizes = {name: n for name, _, n in made}
    assert sizes["inside"] < 6000 + 100 and sizes["across"] < 6000


def by_products(texts, k):
    """(n_shingles, component) of texts by number, over all pairs: intersections as a product of membership matrices."""
    sets = [shingles(t, k) for t in texts]
    shared = {x: i for i, x in enumerate(x for x, n in Counter(x for s in sets for x in s).items() if n > 1)}
    member = np.zeros((len(sets), len(shared)), np.float32)
    for i, s in enumerate(sets):
        member[i, [shared[x] for x in s if x in shared]] = 1
    both, n = member @ member.T, np.array([len(s) for s in sets])
    linked = 100 * both >= 80 * (n[:, None] + n[None, :] - both)
    label = np.arange(len(sets))
    while ((new := np.where(linked, label, len(sets)).min(axis=1)) != label).any():
        label = new
    return list(zip(n.tolist(), label.tolist(), strict=True))


def jaccard(a, b, k):
    x, y = shingles(a, k), shingles(b, k)
    return len(x & y) / len(x | y)


def test_keep_one_with_clashing_names(spark):
    names = ("row_id", "_row_id", "ROW_DIGEST", "bitmap_word", "bitmap_bits", "_gone_id", "_k", "_kept", "cls", "comp", "n", "stays", "first")
    rows = [(1, "a b c d e f", *names), (2, "a b c d e f", *names), (3, "other", *names), (3, "other", *names), (None, None, *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (1, "a b c d e f"), (3, "other")]


def test_two_calls_at_once(spark, planted):
    """Scratch tables of one call are not touched by another's end."""
    df = spark.createDataFrame(planted, "doc_id long, text string")
    with ThreadPoolExecutor(2) as pool:
        a, b = pool.map(lambda k: Counter(map(tuple, minhash.near_duplicates(df, shingle=k).select("doc_id", "n_shingles", "component_id").collect())), (4, 5))
    for k, got in ((4, a), (5, b)):
        assert got == Counter((d, *v) for (d, _), v in zip(planted, brute(planted, k), strict=True))


def test_components(spark):
    rng = random.Random(2)
    edges = [(str(i).zfill(4), str(i + 1).zfill(4)) for i in range(60)] + [(f"{rng.randrange(500, 700):04d}", f"{rng.randrange(500, 700):04d}") for _ in range(120)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    comp = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == comp
    assert components(spark.createDataFrame(edges, "a string, b string").where(F.lit(False))).count() == 0
