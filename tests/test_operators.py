import pytest
from pyspark.sql import functions as F

from tidelog import operators as op
from tidelog.functions import from_unsigned, memtable_size, table_size, to_unsigned, wal_size
from tidelog.plans.fixtures import micros
from tidelog.schema import InvalidRows, canonical, checked

LOG = "series_id long, ts long, seq long, gen long, deleted boolean, value binary"


def log(spark, *writes):
    """(series, ts, value or None) in order of arrival, one generation each."""
    rows = [(s, t, i, i, v is None, None if v is None else v.encode()) for i, (s, t, v) in enumerate(writes)]
    return spark.createDataFrame(rows, LOG)


def times(df):
    return [r.ts for r in df.collect()]


def test_scan_cases(spark):
    df = log(spark, *[(1, t, "v") for t in (10, 20, 30, 40, 50)], (2, 20, "other"))
    for start, end, n in ((0, 100, 5), (15, 35, 2), (30, 30, 1), (100, 200, 0), (1, 9, 0), (35, 15, 0)):
        assert len(times(op.scan(df, 1, start, end))) == n
    assert times(op.scan(df, 1, 0, 100)) == [10, 20, 30, 40, 50]
    assert times(op.scan(df, 9, 0, 100)) == []


def test_scan_hides_deleted_and_shows_newest(spark):
    df = log(spark, (1, 100, "a"), (1, 200, "b"), (1, 200, None), (1, 300, "old"), (1, 300, "new"), (1, -5, ""))
    assert [(r.ts, bytes(r.value)) for r in op.scan(df, 1, -10, 300).collect()] == [(-5, b""), (100, b"a"), (300, b"new")]


def test_three_states(spark):
    df = log(spark, (1, 10, "alpha"), (1, 10, None), (2, 20, "beta"), (3, 30, None), (4, 40, "x"), (4, 40, None), (4, 40, "back"))
    got = {(r.series_id, r.ts): (r.status, r.value and bytes(r.value)) for r in op.get_status(df, [(1, 10), (2, 20), (3, 30), (4, 40), (5, 50), (1, 11)]).collect()}
    assert got == {(1, 10): ("tombstone", None), (2, 20): ("live", b"beta"), (3, 30): ("tombstone", None), (4, 40): ("live", b"back"), (5, 50): ("miss", None), (1, 11): ("miss", None)}
    keys = spark.createDataFrame([(1, 10), (5, 50), (5, 50)], "series_id long, ts long")
    assert sorted((r.series_id, r.status) for r in op.multi_get(df, keys).collect()) == [(1, "tombstone"), (5, "miss")]


def test_a_value_filter_does_not_revive(spark):
    df = log(spark, (1, 1, "match"), (1, 1, "other"))
    assert op.live(df).where(F.col("value") == F.lit(b"match")).count() == 0


def test_compaction(spark):
    df = log(spark, (1, 10, "v1_old"), (2, 20, "v2"), (1, 10, "v1_new"), (3, 30, "v3"), (2, 20, None))
    assert {(r.series_id, bytes(r.value)) for r in op.compact(df, major=True).collect()} == {(1, b"v1_new"), (3, b"v3")}
    assert op.compact(df, major=False).where("deleted").count() == 1
    assert sorted(map(tuple, op.live(op.compact(df, major=False)).collect())) == sorted(map(tuple, op.live(df).collect()))
    assert [tuple(r) for r in op.compact_stats(df).orderBy("series_id").collect()] == [(1, 2, 1, 0, 1), (2, 2, 1, 1, 0), (3, 1, 0, 0, 1)]


def test_history(spark):
    df = log(spark, (1, 1, "a"), (1, 1, None), (1, 1, "b"), (2, 2, "c"))
    assert op.live(op.as_of(df, 1)).count() == 0 and op.live(op.as_of(df, 0)).count() == 1
    assert [tuple(r) for r in op.revived(df).collect()] == [(1, 1, 1)]
    assert sorted(map(tuple, op.replay_tail(df, 1).collect())) == sorted(map(tuple, op.latest(df).collect()))


def test_metadata(spark):
    df = spark.createDataFrame([(1, 5, 0, 0, False, b"x"), (2, -5, 1, 0, True, None), (1, 5, 2, 1, False, b"yy")], LOG)
    assert [tuple(r) for r in op.generation_footers(df).orderBy("gen").collect()] == [(0, 2, 2, 1, 5, 2, -5, 1), (1, 1, 1, 1, 5, 1, 5, 0)]
    assert sorted(r.gen for r in op.generation_candidates(df, 1).collect()) == [0, 1]
    assert {(r.series_id, r.generations) for r in op.read_amplification(df).collect()} == {(1, 2), (2, 1)}
    sizes = df.select(memtable_size(), table_size(), wal_size()).collect()
    assert [tuple(r) for r in sizes] == [(17, 26, 30), (17, 25, 29), (18, 27, 31)]


def test_unsigned_ids_keep_their_order(spark):
    big = [0, 1, 2**63 - 1, 2**63, 2**64 - 1]
    df = spark.createDataFrame([(str(x),) for x in big], "s string").select(F.col("s").cast("decimal(20,0)").alias("u"))
    rows = df.select("u", from_unsigned("u").alias("i")).withColumn("back", to_unsigned("i")).orderBy("i").collect()
    assert [int(r.u) for r in rows] == big and all(r.u == r.back for r in rows)


def test_broken_rows_fail(spark):
    with pytest.raises(InvalidRows):
        canonical(spark.createDataFrame([(1,)], "series_id long"))
    good = (1, 1, 1, False, b"x")
    schema = "series_id long, ts long, seq long, deleted boolean, value binary"
    assert checked(canonical(spark.createDataFrame([good, (1, 2, 1, True, None), (1, 3, 1, False, b"")], schema))).count() == 3
    for bad in ((None, 1, 1, False, b"x"), (-1, 1, 1, False, b"x"), (1, 1, 1, False, None), (1, 1, 1, True, b"x"), (1, 1, None, False, b"x")):
        with pytest.raises(Exception, match="broken log row"):
            checked(canonical(spark.createDataFrame([good, bad], schema))).collect()


def test_key_filters_reach_the_scan(spark):
    path = "/root/testdata/sf0.01/orders.parquet"
    stored = spark.read.parquet(path).select(F.col("o_custkey").alias("series_id"), F.col("o_orderkey").alias("ts"), F.col("o_orderkey").alias("seq"), F.lit(False).alias("deleted"), F.col("o_orderstatus").cast("binary").alias("value"))
    plan = op.scan(stored, 7, 0, 10**6)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,7)" in plan and "WindowGroupLimit" in plan and "o_totalprice" not in plan


def test_times_do_not_depend_on_the_session_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-07-01 12:34:56.789012' AS t, TIMESTAMP_NTZ '1969-12-31 23:59:59.999999' AS u")
    try:
        for zone in ("UTC", "America/New_York", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert tuple(df.select(micros("t"), micros("u")).first()) == (1_719_837_296_789_012, -1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
