import math
import os
import pickle
import subprocess
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard

import corpus_pipeline
from tidelog.llm import chat, minhash, quality, queries, toxicity
from tidelog.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    done = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in done.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    want = sorted(done.fetchall())
    assert sorted(map(tuple, got.select(columns).collect())) == want and len(want) > 10


TURNS = "conv_id long, turn long, role string, text string, pos int, n_turns int"


def turns(*convs):
    return [(c, i, r, t, 0, 0) for c, rows in convs for i, (r, t) in enumerate(rows)]


def test_collapse_cases(spark):
    a, b, c = ("user", "hi"), ("assistant", "yo"), ("user", None)
    rows = turns((1, [a]), (2, [a, b]), (3, [a, b, c]), (4, [a, b, c]), (5, [("user", "")]), (6, [c]), (7, [b, a]), (8, [("user", "hi there")]), (9, [(None, "x")]))
    rows += [(None, 0, "user", "lost", 0, 0), (10, None, "system", "first", 0, 0), (10, 1, "user", "same", 0, 0), (10, 1, "user", "same", 0, 0)]
    df = spark.createDataFrame(rows, TURNS)
    got = {r.conv_id: r for r in chat.collapse(df).collect()}
    assert set(got) == {3, 5, 6, 7, 8, 9, 10}
    assert got[3].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert got[10].n_turns == 3 and got[10].rendered.startswith("<|im_start|>system\nfirst") and got[9].rendered.startswith("<|im_start|>unknown\n")
    assert chat.collapse(df.limit(0)).count() == 0


def test_long_conversation_in_segments(spark):
    long = [("user", f"turn {i}") for i in range(700)]
    df = spark.createDataFrame(turns((1, long), (2, long[:650]), (3, [*long[:649], ("user", "other")])), TURNS).repartition(7)
    got = sorted(chat.collapse(df, stretch=50, segment=200).collect(), key=lambda r: (r.conv_id, r.segment))
    assert [(r.conv_id, r.segment) for r in got] == [(c, s) for c in (1, 3) for s in range(4)]
    assert "".join(r.rendered for r in got if r.conv_id == 1) == "".join(f"<|im_start|>user\nturn {i}<|im_end|>\n" for i in range(700))


def test_hot_turns_are_spread(spark):
    """One turn number of one conversation with most rows, many of them equal: the stretches that tasks sort are short."""
    rows = [(1, 5, "user", f"text {i % 4000:05d}") for i in range(12000)] + [(2, None, "user", f"t{i}") for i in range(3000)] + [(3, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = chat.positions(df, 256).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for conv in (1, 2, 3):
        mine = sorted((r.pos, r.turn, r.role, r.text) for r in placed if r.conv_id == conv)
        assert [x[1:] for x in mine] == sorted(x[1:] for x in rows if x[0] == conv) and [x[0] for x in mine] == list(range(1, len(mine) + 1))
    stretches = Counter((r.conv_id, r.stretch) for r in {(r.conv_id, r.stretch, r.text): r for r in placed}.values())
    assert max(stretches.values()) < 3500 and len(stretches) > 4


def held_out(spark, name, column, rest, fold):
    labels = {r.doc_id: r[column] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = queries.queries()[name](spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == 10000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold == rest) for r in rows)
    test = [(labels[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    y, s, p = (np.array(c, float) for c in zip(*test, strict=True))
    rank = s.argsort().argsort()
    auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
    assert ((0 <= s) & (s <= 1)).all()
    return auc, y, p, rows


def test_op1_held_out(spark):
    auc, y, p, rows = held_out(spark, "op1_toxicity", "toxic", 1, 3)
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    assert auc > 0.88 and p[y == 1].mean() > 0.45 and p[y == 0].mean() < 0.015


def test_op9_held_out(spark):
    auc, y, p, rows = held_out(spark, "op9_quality", "quality", 0, 5)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    assert auc > 0.98 and p[y == 1].mean() > 0.98 and p[y == 0].mean() < 0.3


ODD = [(1, None, 0.5), (2, "", 0.5), (3, " \n ", 0.5), (4, "word " * 50000, 0.5), (5, "same", 0.5), (5, "same", 0.5), (None, "é 日本 🙂", 0.5)]


@pytest.fixture(scope="module")
def models():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    good = [" ".join(rng.choice(words, 80)) for _ in range(120)]
    bad = [" ".join([*rng.choice(words, 70), *rng.choice(["nastyone", "vileword"], 6)]) for _ in range(120)]
    return toxicity.fit(bad, good), quality.fit([t.encode() for t in good + bad], [1] * 120 + [0] * 120), good, bad


def test_classifiers_tell_planted_words(models):
    toxic, fine, good, bad = models
    assert all(b"nasty" in bad and b"nasty" not in fair for fair, bad in toxic.dictionaries)
    assert toxicity.scores(toxic, bad).min() > 0.7 > 0.3 > toxicity.scores(toxic, good).max()
    assert (quality.scores(fine, [t.encode() for t in good]) > 0.5).mean() > 0.95


@pytest.mark.parametrize("space", ["\u00a0", "\u3000", "\u2003", "-", "_", "/"])
def test_toxic_words_count_anywhere_without_ascii_spaces(models, space):
    toxic, _, good, _ = models
    words = " ".join(good[:10]).split()
    for at in (0, 300, 700):
        bad = [*words[:at], *["nastyone", "vileword"] * 4, *words[at:]]
        plain, joined = (toxicity.distances(toxic, [s.join(bad)])[0] for s in (" ", space))
        assert joined.max() > 0 and joined.max() >= plain.max() / 2
        calm = toxicity.distances(toxic, [space.join(words)])[0]
        assert joined.max() > calm.max() and (not space.isspace() or (joined == plain).all())


def test_windows_are_bounded_and_cover_every_piece():
    texts = [toxicity._clean(t) for t in ("", "a b", "\u6587" * 500, "x" * 128, "y" * 129 + " z " * 30, "\u0130" * 60)]
    for size in (1, 8, 24):
        data, windows, first = toxicity._windows(texts, size)
        spans = windows.astype(int).tolist()
        assert max(n for _, n in spans) <= toxicity.LONGEST and spans == sorted(spans)
        ends = np.cumsum([len(t) for t in texts])
        assert [spans[i][0] for i in first] == [0, *ends[:-1]]
        for lo, text in zip([0, *ends[:-1]], texts, strict=True):
            for word in set(text.split()):
                begin = lo + text.index(word)
                for i in range(begin, begin + len(word) - toxicity.OVERLAP + 1):
                    assert any(a <= i and i + toxicity.OVERLAP <= a + n for a, n in spans)


def test_scores_do_not_depend_on_neighbours(models):
    toxic, fine, good, bad = models
    texts = [*good[:5], "", *bad[:5], "x" * 5000]
    assert np.allclose(toxicity.scores(toxic, texts), [toxicity.scores(toxic, [t])[0] for t in texts])
    assert np.allclose(quality.scores(fine, [t.encode() for t in texts]), [quality.scores(fine, [t.encode()])[0] for t in texts], atol=1e-6)


def test_classifiers_on_odd_rows(spark, models):
    df = spark.createDataFrame(ODD, "doc_id long, text string, score double")
    for module, model in ((toxicity, models[0]), (quality, models[1])):
        rows = module.score(df, model).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert module.score(df.limit(0), model).count() == 0
        assert [r.score for r in module.score(df, module.fit([], [])).collect()] == [0.5] * len(ODD)
    assert toxicity.keep_ordinary(df, models[0]).columns == df.columns and quality.keep_good(df, models[1]).schema == df.schema
    assert toxicity.keep_ordinary(df, models[0], threshold=1.1).count() == len(ODD) and quality.keep_good(df, models[1], threshold=1.1).count() == 0


def test_op1_equals_compressing_each_window_alone(spark):
    """The whole query's scores from plain loops: words to windows, one compression for each, counts and the logistic function."""
    model = queries.toxicity_model(spark, SF)
    s = model.settings
    assert len(model.dictionaries) == s.pairs and s.window >= 32 and all(len(d) > 4 * s.own for pair in model.dictionaries for d in pair)
    params = zstandard.ZstdCompressionParameters(window_log=19, hash_log=17, chain_log=17, search_log=5, min_match=s.min_match, target_length=1, strategy=zstandard.STRATEGY_FAST, write_content_size=False, write_checksum=False, write_dict_id=False)
    plain = [[zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params) for d in pair] for pair in model.dictionaries]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.score for r in queries.op1_toxicity(spark, SF).collect()}
    assert got.keys() == docs.keys()
    checked = 0
    for doc_id in sorted(docs)[::7]:
        clean = toxicity._clean(docs[doc_id])
        if len(clean) > 20000:
            continue
        cuts, at = [0], s.window
        while at < len(clean):
            if (at := clean.index(b" ", at)) > cuts[-1] and at < len(clean) - 1:
                cuts.append(at)
            at = (at // s.window + 1) * s.window
        windows = [clean[a : b + 1] for a, b in zip(cuts, [*cuts[1:], len(clean)], strict=True)]
        if max(map(len, windows)) > toxicity.LONGEST:
            continue
        d = sorted((sum(len(o.compress(w)) - len(t.compress(w)) for o, t in plain) for w in windows), reverse=True)
        over = [sum(x >= t for x in d) for t in model.thresholds]
        x = [*(math.log1p(max(0, sum(d[:k]))) for k in (1, 3, 8)), *map(math.log1p, over), *(math.sqrt(n / len(d)) for n in over), math.log1p(len(d))]
        z = model.bias + sum(w * (v - m) / c for w, v, m, c in zip(model.weights, x, model.mean, model.scale, strict=True))
        assert abs(got[doc_id] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9
        checked += 1
    assert checked > 80


def test_op9_equals_direct_convolution(spark):
    """The whole query's scores from plain loops over chunks, places and filters."""
    model = queries.quality_model(spark, SF)
    s = model.settings
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.score for r in queries.op9_quality(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for doc_id in sorted(docs, key=lambda d: (len(docs[d]), d))[:: len(docs) // 40][:38]:
        text = (docs[doc_id] or "").encode()
        blocks = -(-(len(text) + s.width - 1) // s.block)
        padded = bytes(s.width - 1) + text + bytes(blocks * s.block)
        response = np.array([sum(model.tables[k][padded[i + k]] for k in range(s.width)) for i in range(blocks * s.block)])
        chunks = [response[b * s.block : (b + 2) * s.block] for b in range(max(1, blocks - 1))]
        pooled = np.mean([np.maximum(c.max(axis=0) + model.bias, 0) for c in chunks], axis=0)
        assert abs(got[doc_id] - 1 / (1 + math.exp(-(pooled @ model.weights + model.offset)))) < 1e-4


def test_memory_of_a_very_long_text(models):
    """Fifty megabytes are scored in less memory than six copies of the text."""
    code = """
import pickle, resource, sys
from tidelog.llm import toxicity
model = pickle.load(sys.stdin.buffer)
text = "some plain words of a long text " * 1_600_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
score = toxicity.scores(model, [text])[0]
print(score, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], input=pickle.dumps(models[0]), capture_output=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    score, grown = map(float, done.stdout.split())
    assert 0 <= score <= 1 and grown < 250


def test_stretches_hold_the_whole_text_and_cut_at_white_space():
    text = "word and " * 70000 + "x" * 600_000 + " end"
    parts = list(toxicity.stretches(text))
    assert b"".join(parts).replace(b" ", b"") == text.replace(" ", "").encode() and len(parts) > 4 and all(p[-5:].strip() in (b"word", b"and", b"ord", b"nd") for p in parts[:2])
    assert list(toxicity.stretches("")) == [b"  "]


def test_pipeline_stages_follow_the_operators(spark):
    """Each stage against its operator's own scores or groups, on all that its predecessor kept."""
    docs = table(spark, SF, "documents")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    (_, good), (_, clean), (_, single), (_, packed) = corpus_pipeline.STAGES
    first = good(spark, docs, SF)
    assert first.columns == docs.columns
    assert ids(first) == {r.doc_id for r in quality.score(docs, queries.quality_model(spark, SF)).collect() if r.score >= 0.3}
    second = clean(spark, first, SF)
    assert ids(second) == {r.doc_id for r in toxicity.score(first, queries.toxicity_model(spark, SF)).collect() if r.score < 0.7}
    third = single(spark, second, SF)
    assert third.columns == docs.columns and third.count() == third.select("doc_id").distinct().count()
    assert ids(third) == {r.doc_id for r in minhash.near_duplicates(second, shingle=5).collect() if r.kept}
    pieces = packed(spark, third, SF).collect()
    assert {r.doc_id for r in pieces} == ids(third)
    run = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in run if r.length == 2048) == Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces if r.length == 2048)
    assert sum(r.length for r in run) == sum(r.length for r in pieces)


def test_the_sample_of_labelled_texts_is_bounded_in_bytes(spark, tmp_path, monkeypatch):
    """Long texts on many labelled rows would not fit the driver; fewer are taken, each whole, of both classes."""
    texts = {i: f"{i} " + "word " * (20_000 if i == 7 else 200) for i in range(600)}
    spark.createDataFrame([*texts.items(), (0, texts[0])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 2) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    full = queries.labelled_sample(spark, str(tmp_path), "toxic", 3, 1)
    assert len(full) == 1 + sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in texts)  # 0 is in the sample, twice
    monkeypatch.setattr(queries, "SAMPLE_BYTES", {"toxic": (20_000, 40_000)})
    few = queries.labelled_sample(spark, str(tmp_path), "toxic", 3, 1)
    assert 18_000 < sum(len(t) for y, t in few if y) <= 20_000 and 38_000 < sum(len(t) for y, t in few if not y) <= 40_000
    assert all(t == texts[int(t.split()[0])] and y == int(t.split()[0]) % 2 for y, t in few)
    assert [r for r in full if r in few] == few
