import glob
import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from tidelog.sources import CommitConflict, StoreConfig, open_store
from tidelog.sources.manifest import Manifest, Snapshot
from tidelog.streaming import ingest, newest_per_key

SCHEMA = "series_id long, ts long, seq long, deleted boolean, value binary"


@pytest.fixture
def store(spark, tmp_path):
    return open_store(spark, f"file://{tmp_path}/s")


def batch(spark, *writes):
    return spark.createDataFrame([(s, t, i, v is None, v) for i, (s, t, v) in enumerate(writes)], SCHEMA)


def test_example(store):
    for t in (100, 200, 300, 400):
        store.insert(1, t, f"v{t}".encode())
    assert store.get(1, 200) == (b"v200", True, False)
    store.delete(1, 200)
    assert [t for _, t, _ in store.scan_iterator(1, 0, 1000)] == [100, 300, 400]
    assert store.get(1, 200) == (None, False, True) and store.get(9, 9) == (None, False, False)


def test_reopen_and_empty_values(spark, store):
    store.insert(1, 10, b"alpha")
    store.insert(1, 20, None)
    store.delete(3, -5)
    store.close()
    store.close()
    again = open_store(spark, store.path)
    assert again.get(1, 10) == (b"alpha", True, False) and again.get(1, 20) == (b"", True, False) and again.get(3, -5) == (None, False, True)
    with pytest.raises(ValueError):
        store.insert(1, 1, b"")
    assert len(again.recover().generations) == 1


def test_flush_threshold_and_nothing_to_flush(spark, tmp_path):
    with open_store(spark, f"file://{tmp_path}/t", StoreConfig(flush_bytes=64)) as store:
        for i in range(5):
            store.insert(i, i, b"0123456789abcdef")
        assert len(store.manifest.read().generations) == 2
        store.flush()
        version = store.manifest.read().version
        assert store.flush().version == version == 3
    assert StoreConfig(flush_bytes=0).flush_bytes == 4 << 20


def test_later_commits_win_whatever_their_seq(spark, store):
    store.append(spark.createDataFrame([(1, 1, 99, False, b"old")], SCHEMA))
    store.append(spark.createDataFrame([(1, 1, 1, False, b"new"), (1, 1, 0, False, b"shadowed")], SCHEMA))
    assert store.get(1, 1)[0] == b"new" and store.log().count() == 2


def test_compaction(spark, store):
    store.append(batch(spark, (1, 10, b"v1_old"), (2, 20, b"v2"), (4, 40, b"gone")))
    store.append(batch(spark, (1, 10, b"v1_new"), (3, 30, b"v3"), (4, 40, None)))
    pinned = store.snapshot()
    after = store.compact(major=False)
    assert len(after.generations) == 1 and after.generations[0].tombstones == 1 and store.get(4, 40) == (None, False, True)
    after = store.compact()
    assert [(g.gen, g.rows, g.tombstones) for g in after.generations] == [(2, 3, 0)] and store.get(4, 40) == (None, False, False)
    assert store.get(1, 10)[0] == b"v1_new" and store.scan(4, 0, 100, pinned).count() == 0 and store.log(pinned).count() == 6
    assert store.vacuum(retention_s=3600) == []
    assert len(store.vacuum(retention_s=-1)) == 3 and store.live().count() == 3


def test_major_compaction_of_tombstones_alone_leaves_nothing(spark, store):
    store.append(batch(spark, (1, 100, b"data")))
    store.append(batch(spark, (1, 100, None)))
    assert store.compact().generations == () and store.live().count() == 0 and store.get(1, 100) == (None, False, False)


def test_only_safe_compactions(spark, store):
    for v in (b"a", b"b", None):
        store.append(batch(spark, (1, 1, v)))
    with pytest.raises(ValueError, match="oldest"):
        store.compact(major=True, gens=[2, 3])
    with pytest.raises(ValueError, match="neighbouring"):
        store.compact(major=False, gens=[1, 3])
    with pytest.raises(ValueError, match="no such"):
        store.compact(major=False, gens=[7])
    store.compact(major=False, gens=[2, 3])
    assert [g.gen for g in store.snapshot().generations] == [1, 3] and store.get(1, 1) == (None, False, True)


def test_append_during_compaction_is_not_outranked(spark, store, monkeypatch):
    store.append(batch(spark, (1, 1, b"a")))
    store.append(batch(spark, (1, 1, b"b")))
    write = store._write

    def slow(df):
        made = write(df)
        monkeypatch.setattr(store, "_write", write)
        store.append(batch(spark, (1, 1, b"c")))
        return made

    monkeypatch.setattr(store, "_write", slow)
    store.compact()
    assert store.get(1, 1)[0] == b"c" and [g.gen for g in store.snapshot().generations] == [2, 3]


def test_two_compactions_conflict(spark, store, monkeypatch):
    store.append(batch(spark, (1, 1, b"a")))
    store.append(batch(spark, (2, 2, b"b")))
    write = store._write

    def overtaken(df):
        monkeypatch.setattr(store, "_write", write)
        store.compact()
        return write(df)

    monkeypatch.setattr(store, "_write", overtaken)
    with pytest.raises(CommitConflict):
        store.compact()
    assert store.live().count() == 2


def test_unfinished_writes_are_invisible(spark, store):
    store.append(batch(spark, (1, 1, b"a")))
    store._write(batch(spark, (1, 1, b"never committed")))
    path = store.path.removeprefix("file://")
    open(f"{path}/_commits/.half.tmp", "w").write("{")
    again = open_store(spark, store.path)
    assert again.get(1, 1)[0] == b"a"
    assert len(again.vacuum(retention_s=-1)) == 1


def test_damaged_page_fails(spark, store):
    store.append(batch(spark, *[(1, t, os.urandom(64)) for t in range(2000)]))
    path = store.path.removeprefix("file://")
    for f in glob.glob(f"{path}/data/*/*.parquet"):
        data = bytearray(open(f, "rb").read())
        data[len(data) // 2] ^= 0xFF
        open(f, "wb").write(data)
        os.remove(f"{os.path.dirname(f)}/.{os.path.basename(f)}.crc")
    with pytest.raises(Exception, match="(?i)checksum|corrupt|parquet"):
        store.live().collect()


def test_concurrent_writers(spark, store):
    def write(w):
        for i in range(3):
            store.append(spark.createDataFrame([(w * 1000 + i, i, 0, False, f"{w}-{i}".encode())], SCHEMA))

    threads = [threading.Thread(target=write, args=(w,)) for w in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert store.live().count() == 12 and store.manifest.read().version == 12
    store.compact()
    assert store.live().count() == 12


def test_manifest_publishes_once(spark, tmp_path):
    m = Manifest(spark, f"file://{tmp_path}/m")
    assert m._publish(1, "{}") and not m._publish(1, "{}")
    assert m.versions() == [1] and Manifest(spark, f"file://{tmp_path}/n").read() == Snapshot()


def test_random_operations_follow_a_dictionary(spark, tmp_path):
    rng, model, purged = random.Random(11), {}, set()
    store = open_store(spark, f"file://{tmp_path}/fuzz")
    for _ in range(6):
        for _ in range(rng.randint(1, 12)):
            key = (rng.randrange(3), rng.randrange(-3, 4))
            if rng.random() < 0.3:
                store.delete(*key)
                model[key] = None
            else:
                model[key] = f"v{rng.random()}".encode()
                store.insert(*key, model[key])
        what = rng.choice(["flush", "major", "minor", "reopen", "none"])
        if what == "flush":
            store.flush()
        elif what in ("major", "minor"):
            store.compact(major=what == "major")
            if what == "major":
                model = {k: v for k, v in model.items() if v is not None}
        elif what == "reopen":
            store.close()
            store = open_store(spark, store.path)
        live = {(r.series_id, r.ts): bytes(r.value) for r in store.live().collect()}
        assert live == {k: v for k, v in model.items() if v is not None}
        s = rng.randrange(3)
        assert [t for _, t, _ in store.scan_iterator(s, -2, 2)] == sorted(t for (a, t), v in model.items() if a == s and -2 <= t <= 2 and v is not None)
        keys = spark.createDataFrame([(a, t) for a in range(3) for t in range(-3, 4)], "series_id long, ts long")
        status = {(r.series_id, r.ts): r.status for r in store.multi_get(keys).collect()}
        assert all(x == ("miss" if k not in model else "tombstone" if model[k] is None else "live") for k, x in status.items())


def test_bloom_and_order_in_files(spark, store):
    rng = random.Random(1)
    store.append(spark.createDataFrame([(2 * rng.randrange(5000), t, t, False, b"x") for t in range(4000)], SCHEMA))
    rows = spark.read.parquet(f"{store.path}/data/{store.snapshot().generations[0].folder}").collect()
    keys = [(r.series_id, r.ts) for r in rows]
    assert keys == sorted(keys)
    assert store.get(1, 1) == (None, False, False)


def test_reads_open_only_generations_that_may_hold_the_key(spark, store, monkeypatch):
    for k in range(6):
        store.append(batch(spark, *((10 * k + i, 100 * k, b"v%d" % k) for i in range(5))))
    opened = []
    real = store._files
    monkeypatch.setattr(store, "_files", lambda folders: opened.append(len(folders)) or real(folders))
    assert store.get(23, 200) == (b"v2", True, False) and opened == [1]
    assert store.get(7, 100) == (None, False, False) and store.get(23, 201) == (None, False, False) and opened == [1]
    assert [r.ts for r in store.scan(40, 0, 10**6).collect()] == [400] and opened == [1, 1]
    assert store.scan(23, 0, 100).count() == 0 and opened == [1, 1]
    g = store.snapshot().generations[3]
    assert (g.first_series, g.last_series, g.first_ts, g.last_ts, g.rows) == (30, 34, 300, 300, 5)


def test_bloom_filter_size_follows_the_data(spark, tmp_path):
    sizes = []
    for n in (100, 100_000):
        store = open_store(spark, f"file://{tmp_path}/{n}")
        store.append(spark.range(n).selectExpr("id AS series_id", "0L AS ts", "id AS seq", "false AS deleted", "cast('x' AS binary) AS value").coalesce(1))
        data = f"{tmp_path}/{n}/data/{store.snapshot().folders[0]}"
        sizes.append(sum(os.path.getsize(f"{data}/{f}") for f in os.listdir(data) if f.endswith(".parquet")))
        assert store.get(n, 0) == (None, False, False) and store.get(n - 1, 0)[0] == b"x"
    assert sizes[0] < 40_000


def test_generations_stay_bounded(spark, tmp_path):
    store = open_store(spark, f"file://{tmp_path}/s", StoreConfig(max_generations=4))
    for k in range(12):
        store.append(batch(spark, (1, k % 5, b"%d" % k), (2, k, None if k % 3 else b"%d" % k)))
        store.settle()
        assert len(store.snapshot().generations) <= 4
    assert {r.ts: bytes(r.value) for r in store.scan(1, 0, 10).collect()} == {0: b"10", 1: b"11", 2: b"7", 3: b"8", 4: b"9"}
    assert store.get(2, 4) == (None, False, True) and [r.ts for r in store.scan(2, 0, 99).collect()] == [0, 3, 6, 9]


def test_commits_are_listed_and_dropped(spark, store):
    for k in range(4):
        store.append(batch(spark, (1, k, b"x")))
    assert store.commits() == [1, 2, 3, 4] and store.commits(2) == [1, 2]
    assert store.drop_commits(2) == [1, 2] and store.commits() == [3, 4] and store.live().count() == 4
    assert store.drop_commits(99) == [3] and store.live().count() == 4


def test_old_manifests_are_read(spark, store):
    """A generation without key ranges, or with a field that is no longer known, is read in full."""
    store.append(batch(spark, (1, 1, b"x")))
    path = f"{store.path.removeprefix('file://')}/_commits/{1:020d}.json"
    raw = json.loads(open(path).read())
    raw["generations"] = [{"gen": g["gen"], "folder": g["folder"], "rows": g["rows"], "buckets": 0} for g in raw["generations"]]
    os.remove(path)
    crc = f"{os.path.dirname(path)}/.{os.path.basename(path)}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    with open(path, "w") as f:
        json.dump(raw, f)
    assert store.get(1, 1)[0] == b"x"


def test_stream_is_applied_once(spark, store, tmp_path):
    writes = batch(spark, (1, 1, b"a"), (1, 1, None), (2, 2, b"b"))
    writes.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    read = lambda: spark.readStream.schema(writes.schema).parquet(f"file://{tmp_path}/in")
    ingest(read(), store, f"file://{tmp_path}/ck").awaitTermination()
    assert store.get(1, 1) == (None, False, True) and store.get(2, 2)[0] == b"b"
    before = store.manifest.read()
    store.append(batch(spark, (2, 2, b"retried")), transaction=("ingest", 0))
    assert store.manifest.read() == before
    batch(spark, (2, 2, b"c")).write.mode("append").parquet(f"file://{tmp_path}/in")
    ingest(read(), store, f"file://{tmp_path}/ck").awaitTermination()
    assert store.get(2, 2)[0] == b"c" and len(store.snapshot().generations) == 2


def test_newest_per_key_stream(spark, tmp_path):
    batch(spark, (1, 1, b"a"), (1, 1, b"b"), (2, 2, None)).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")
    q = newest_per_key(stream).writeStream.format("memory").queryName("newest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.series_id, r.deleted) for r in spark.table("newest").select("series_id", "deleted", F.col("value")).collect()) == [(1, False), (2, True)]


def test_single_writes_flush_without_a_job_and_stay_bounded(spark, tmp_path, monkeypatch):
    """Many flushes neither start a Spark job each, nor list all commits, nor leave a generation each."""
    store = open_store(spark, f"file://{tmp_path}/s", StoreConfig(flush_bytes=64, max_generations=4))
    written, listed = [], []
    write, versions = store._write, store.manifest.versions
    monkeypatch.setattr(store, "_write", lambda df: written.append(1) or write(df))
    monkeypatch.setattr(store.manifest, "versions", lambda: listed.append(1) or versions())
    store.insert(5, 9, b"shadowed")
    store.insert(5, 9, b"new")
    store.delete(3, -4)
    store.flush()
    g = store.snapshot().generations[0]
    assert not written and (g.rows, g.tombstones, g.first_series, g.last_series, g.first_ts, g.last_ts) == (2, 1, 3, 5, -4, 9)
    assert store.get(5, 9) == (b"new", True, False) and store.get(3, -4) == (None, False, True)
    for i in range(24):
        store.insert(i % 8, i % 8, b"%016d" % i)
        store.insert(100 + i, -i, b"%016d" % i)
    assert len(store.snapshot().generations) <= 5 and len(written) < 8 and len(listed) <= 2
    live = {(r.series_id, r.ts): int(r.value) for r in store.live().where("series_id <> 5 OR ts <> 9").collect()}
    assert live == {(i % 8, i % 8): i for i in range(24)} | {(100 + i, -i): i for i in range(24)}


def test_another_writers_commits_are_seen(spark, store):
    """The newest version is found from the last known one, also where that has been dropped since."""
    other = open_store(spark, store.path)
    store.insert(1, 1, b"a")
    store.flush()
    assert other.manifest.read().version == 1
    for k in range(3):
        store.insert(1, 1, b"%d" % k)
        store.flush()
    store.drop_commits(3)
    assert other.manifest.read().version == 4 and other.get(1, 1)[0] == b"2"
    other.insert(1, 1, b"last")
    other.close()
    assert store.manifest.read().version == 5 and store.get(1, 1)[0] == b"last"


def test_damaged_flush_fails(spark, store):
    for t in range(500):
        store.insert(1, t, os.urandom(64))
    store.flush()
    for f in glob.glob(f"{store.path.removeprefix('file://')}/data/*/*.parquet"):
        data = bytearray(open(f, "rb").read())
        data[len(data) // 2] ^= 0xFF
        open(f, "wb").write(data)
        os.remove(f"{os.path.dirname(f)}/.{os.path.basename(f)}.crc")
    with pytest.raises(Exception, match="(?i)checksum|corrupt|parquet"):
        store.live().collect()
