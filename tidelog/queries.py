"""The registered queries of the engine and their equivalents in SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as op
from .functions import memtable_size, table_size, wal_size
from .plans import conversations_log, events_log, lineitem_log, orders_log
from .plans.fixtures import LINEITEM_ORDER
from .sources import StoreConfig, open_store
from .streaming import ingest

#: The point and range that lookups ask for: the feature itself, not a cut of the input.
SERIES, START, END, SINGLE = 7, 1_704_412_800_000_000, 1_705_708_800_000_000, 1_704_240_000_000_000
KEYS = [(7, 1_704_412_800_000_000), (7, 1_704_499_200_000_000), (7, 1_704_585_600_000_000), (7, 1_704_672_000_000_000), (7, 1_704_412_800_000_001), (123_456_789, 0)]


def text(df: DataFrame) -> DataFrame:
    """Values as text, for comparison."""
    return df.withColumn("value", F.col("value").cast("string"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text(op.live(events_log(spark, sf_dir)))


def log_append(spark, sf_dir):
    return text(events_log(spark, sf_dir))


def get_status(spark, sf_dir):
    return text(op.get_status(events_log(spark, sf_dir), KEYS))


def multi_get(spark, sf_dir):
    """Every key that was ever written, and the time just after it, which never was."""
    log = events_log(spark, sf_dir)
    keys = log.select("series_id", F.explode(F.array("ts", F.col("ts") + 1)).alias("ts"))
    return text(op.multi_get(log, keys))


def scan_range(spark, sf_dir):
    return text(op.scan(events_log(spark, sf_dir), SERIES, START, END))


def scan_single_ts(spark, sf_dir):
    return text(op.scan(events_log(spark, sf_dir), SERIES, SINGLE, SINGLE))


def scan_inverted(spark, sf_dir):
    return text(op.scan(events_log(spark, sf_dir), SERIES, END, START))


def scan_all_series(spark, sf_dir):
    return text(op.live(events_log(spark, sf_dir)))


def merge_live_lineitem(spark, sf_dir):
    return text(op.live(lineitem_log(spark, sf_dir)))


def merge_live_orders(spark, sf_dir):
    return text(op.live(orders_log(spark, sf_dir)))


def compact_major(spark, sf_dir):
    return text(op.compact(events_log(spark, sf_dir), major=True))


def compact_minor(spark, sf_dir):
    return text(op.compact(events_log(spark, sf_dir), major=False))


def compact_prefix_minor(spark, sf_dir):
    return text(op.compact(events_log(spark, sf_dir).where("gen < 10"), major=False))


def compact_stats(spark, sf_dir):
    return op.compact_stats(events_log(spark, sf_dir))


def snapshot_as_of(spark, sf_dir):
    return text(op.live(op.as_of(events_log(spark, sf_dir), 5000)))


def wal_replay_tail(spark, sf_dir):
    return text(op.replay_tail(events_log(spark, sf_dir), 2))


def reinsert_revives(spark, sf_dir):
    return op.revived(events_log(spark, sf_dir))


def gen_footer(spark, sf_dir):
    return op.generation_footers(events_log(spark, sf_dir))


def gen_candidates(spark, sf_dir):
    return op.generation_candidates(events_log(spark, sf_dir), SERIES)


def read_amplification(spark, sf_dir):
    return op.read_amplification(events_log(spark, sf_dir))


def _bytes(spark, sf_dir, size, name):
    return events_log(spark, sf_dir).groupBy("gen").agg(F.sum(size).alias(name))


def memtable_bytes(spark, sf_dir):
    return _bytes(spark, sf_dir, memtable_size(), "memtable_bytes")


def sst_bytes(spark, sf_dir):
    return _bytes(spark, sf_dir, table_size(), "sst_bytes")


def wal_bytes(spark, sf_dir):
    return _bytes(spark, sf_dir, wal_size(), "wal_bytes")


def ordered_scan_conversations(spark, sf_dir):
    return text(op.live(conversations_log(spark, sf_dir))).orderBy("series_id", "ts")


def _scratch(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/tidelog-store-{uuid.uuid4().hex}"


def _loaded(spark: SparkSession, sf_dir: str):
    """A store with the events log in four commits, cut by generation."""
    store, log = open_store(spark, _scratch(spark)), events_log(spark, sf_dir)
    last = log.agg(F.max("gen")).first()[0] or 0
    bounds = [-1, last // 4, last // 2, 3 * last // 4, last]
    for low, high in zip(bounds, bounds[1:], strict=False):
        store.append(log.where((F.col("gen") > low) & (F.col("gen") <= high)))
    return store


def store_live(spark, sf_dir):
    """Live view of a store of four generations."""
    return text(_loaded(spark, sf_dir).live())


def store_compact_major(spark, sf_dir):
    """Live view after a minor compaction of two neighbours and a major one of all."""
    store = _loaded(spark, sf_dir)
    store.compact(major=False, gens=[g.gen for g in store.snapshot().generations[1:3]])
    store.compact(major=True)
    return text(store.live())


def store_scan_range(spark, sf_dir):
    return text(_loaded(spark, sf_dir).scan(SERIES, START, END))


def store_multi_get(spark, sf_dir):
    keys = events_log(spark, sf_dir).select("series_id", F.explode(F.array("ts", F.col("ts") + 1)).alias("ts"))
    return text(_loaded(spark, sf_dir).multi_get(keys))


def store_pinned(spark, sf_dir):
    """Live view pinned to the second of four commits, read after later commits and a compaction."""
    store = _loaded(spark, sf_dir)
    pinned = store.snapshot(store.commits()[1])
    store.compact(major=True)
    return text(store.live(pinned))


def store_vacuumed(spark, sf_dir):
    """Live view after a major compaction, dropped commits and a vacuum that keeps no old files."""
    store = _loaded(spark, sf_dir)
    store.compact(major=True)
    store.drop_commits(store.snapshot().version)
    store.vacuum(retention_s=0)
    return text(store.live())


def store_flush_close(spark, sf_dir):
    """Every conversation turn inserted one by one with a small buffer, the store closed and opened again."""
    path = _scratch(spark)
    with open_store(spark, path, StoreConfig(flush_bytes=64 << 10)) as store:
        for r in conversations_log(spark, sf_dir).toLocalIterator():
            store.insert(r.series_id, r.ts, bytes(r.value or b""))
    return text(open_store(spark, path).live())


def stream_ingest_live(spark, sf_dir):
    """The events log written as files, ingested as a stream, then read live."""
    base = _scratch(spark)
    events_log(spark, sf_dir).drop("gen").write.parquet(f"{base}/in")
    stored = spark.read.parquet(f"{base}/in")
    store = open_store(spark, f"{base}/store")
    ingest(spark.readStream.schema(stored.schema).parquet(f"{base}/in"), store, f"{base}/checkpoint").awaitTermination()
    return text(store.live())


_QUERIES = (
    log_append, get_status, multi_get, scan_range, scan_single_ts, scan_inverted, scan_all_series, merge_live_lineitem, merge_live_orders, compact_major, compact_minor,
    compact_prefix_minor, compact_stats, snapshot_as_of, wal_replay_tail, reinsert_revives, gen_footer, gen_candidates, read_amplification, memtable_bytes, sst_bytes,
    wal_bytes, ordered_scan_conversations, store_live, store_compact_major, store_scan_range, store_multi_get, store_pinned, store_vacuumed, store_flush_close,
    stream_ingest_live,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


LOG_A = """WITH log AS (
  SELECT user_id AS series_id, (epoch_us(ts) // 86400000000) * 86400000000 AS ts, event_id AS seq, event_id // 250 AS gen,
         event_type = 'error' AS deleted, CASE WHEN event_type <> 'error' THEN props END AS value FROM events)"""
LOG_B = f"""WITH log AS (
  SELECT l_suppkey AS series_id, epoch_us(l_shipdate) AS ts, row_number() OVER (ORDER BY {", ".join(LINEITEM_ORDER)}) AS seq,
         l_returnflag = 'R' AS deleted, CASE WHEN l_returnflag <> 'R' THEN l_linestatus END AS value FROM lineitem)"""
LOG_C = """WITH log AS (
  SELECT o_custkey AS series_id, epoch_us(o_orderdate) AS ts, o_orderkey AS seq, o_orderstatus = 'F' AS deleted,
         CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS value FROM orders)"""


def _ranked(log: str, where: str = "TRUE") -> str:
    return f"{log}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY seq DESC) AS rn FROM log WHERE {where})\n"


def _live(log: str, where: str = "TRUE") -> str:
    return _ranked(log, where) + "SELECT series_id, ts, value FROM r WHERE rn = 1 AND NOT deleted"


def oracle_sql() -> dict[str, str]:
    whole = "SELECT series_id, ts, seq, gen, deleted, value FROM r WHERE rn = 1"
    status = """SELECT k.series_id, k.ts, CASE WHEN r.deleted IS NULL THEN 'miss' WHEN r.deleted THEN 'tombstone' ELSE 'live' END AS status, r.value
FROM k LEFT JOIN r ON r.series_id = k.series_id AND r.ts = k.ts AND r.rn = 1"""
    literal = ", ".join(f"({s}, {t})" for s, t in KEYS)
    every_key = _ranked(LOG_A) + f", k AS (SELECT DISTINCT series_id, unnest([ts, ts + 1]) AS ts FROM log)\n{status}"
    in_range = f"series_id = {SERIES} AND ts BETWEEN {START} AND {END}"
    value_bytes = "coalesce(strlen(value), 0)"
    sums = lambda what, name: f"{LOG_A}\nSELECT gen, CAST(sum({what}) AS BIGINT) AS {name} FROM log GROUP BY gen"
    return {
        "log_append": f"{LOG_A}\nSELECT series_id, ts, seq, gen, deleted, value FROM log",
        "get_status": _ranked(LOG_A) + f", k AS (SELECT CAST(a AS BIGINT) AS series_id, CAST(b AS BIGINT) AS ts FROM (VALUES {literal}) v(a, b))\n{status}",
        "multi_get": every_key,
        "scan_range": _live(LOG_A, in_range),
        "scan_single_ts": _live(LOG_A, f"series_id = {SERIES} AND ts = {SINGLE}"),
        "scan_inverted": _live(LOG_A, f"series_id = {SERIES} AND ts BETWEEN {END} AND {START}"),
        "scan_all_series": _live(LOG_A),
        "merge_live_lineitem": _live(LOG_B),
        "merge_live_orders": _live(LOG_C),
        "compact_major": _ranked(LOG_A) + whole + " AND NOT deleted",
        "compact_minor": _ranked(LOG_A) + whole,
        "compact_prefix_minor": _ranked(LOG_A, "gen < 10") + whole,
        "compact_stats": _ranked(LOG_A)
        + """SELECT series_id, count(*) AS input_rows, CAST(sum(CASE WHEN rn > 1 THEN 1 ELSE 0 END) AS BIGINT) AS shadowed,
  CAST(sum(CASE WHEN rn = 1 AND deleted THEN 1 ELSE 0 END) AS BIGINT) AS tombstones,
  CAST(sum(CASE WHEN rn = 1 AND NOT deleted THEN 1 ELSE 0 END) AS BIGINT) AS output_rows FROM r GROUP BY series_id""",
        "snapshot_as_of": _live(LOG_A, "seq <= 5000"),
        "wal_replay_tail": _ranked(LOG_A) + whole,
        "reinsert_revives": f"""{LOG_A}, b AS (SELECT *, lag(deleted) OVER (PARTITION BY series_id, ts ORDER BY seq) AS before FROM log)
SELECT series_id, ts, count(*) AS revivals FROM b WHERE before AND NOT deleted GROUP BY series_id, ts""",
        "gen_footer": f"""{LOG_A}, f AS (SELECT gen, count(*) AS entries, count(DISTINCT series_id) AS series, min(series_id) AS min_series, max(series_id) AS max_series,
  CAST(sum(CASE WHEN deleted THEN 1 ELSE 0 END) AS BIGINT) AS tombstones FROM log GROUP BY gen)
SELECT gen, entries, series, min_series, (SELECT min(ts) FROM log WHERE log.gen = f.gen AND series_id = min_series) AS min_ts, max_series,
  (SELECT max(ts) FROM log WHERE log.gen = f.gen AND series_id = max_series) AS max_ts, tombstones FROM f""",
        "gen_candidates": f"{LOG_A}\nSELECT DISTINCT gen FROM log WHERE series_id = {SERIES}",
        "read_amplification": f"{LOG_A}\nSELECT series_id, ts, count(DISTINCT gen) AS generations FROM log GROUP BY series_id, ts",
        "memtable_bytes": sums(f"CASE WHEN deleted THEN 17 ELSE 16 + {value_bytes} END", "memtable_bytes"),
        "sst_bytes": sums(f"25 + {value_bytes}", "sst_bytes"),
        "wal_bytes": sums(f"29 + {value_bytes}", "wal_bytes"),
        "ordered_scan_conversations": "SELECT conv_id AS series_id, turn AS ts, coalesce(text, '') AS value FROM conversations",
        "store_live": _live(LOG_A),
        "store_compact_major": _live(LOG_A),
        "store_scan_range": _live(LOG_A, in_range),
        "store_multi_get": every_key,
        "store_pinned": _live(LOG_A, "gen <= (SELECT max(event_id // 250) // 2 FROM events)"),
        "store_vacuumed": _live(LOG_A),
        "store_flush_close": "SELECT conv_id AS series_id, turn AS ts, coalesce(text, '') AS value FROM conversations",
        "stream_ingest_live": _live(LOG_A),
    }
