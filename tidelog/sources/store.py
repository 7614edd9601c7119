"""A time-series store of change-log generations: append, read, compact.

A generation is a folder of Parquet files, range-partitioned and sorted by (series_id, ts), with a Bloom filter on
series_id, page checksums on; a flush of buffered writes is one such file, made on the driver without a Spark job and, being
small, without the filter, which its compaction adds. A generation's rank against others is the version of the commit that published it, so the
order of arrival is the order of commits. A compaction takes neighbouring generations and ranks as the newest of
them, so it can never outrank a write that came later; a major one must start at the oldest generation, since a
tombstone may only go when nothing older is left.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import lww
from ..schema import KEY, LOG, STORED, canonical, checked
from .manifest import CommitConflict, Generation, Manifest, Snapshot

#: STORED for a file that the driver writes.
_FILE = pa.schema([pa.field("series_id", pa.int64(), False), pa.field("ts", pa.int64(), False), pa.field("seq", pa.int64(), False), pa.field("deleted", pa.bool_(), False), pa.field("value", pa.binary())])


@dataclass(frozen=True)
class StoreConfig:
    """flush_bytes: buffered single writes are committed at this size, counted 16 + value bytes, 17 for a delete.
    rows_per_file: of a generation's files, at most. bloom_fpp: of the filter on series_id, whose size follows
    the distinct series that a row group holds, up to bloom_bytes. row_group_bytes: of Parquet row groups. max_generations: settle, and
    inserts that flush, compact beyond so many. retention_s: age of unreferenced files that vacuum removes."""

    flush_bytes: int = 4 << 20
    rows_per_file: int = 5_000_000
    bloom_fpp: float = 0.01
    bloom_bytes: int = 1 << 20
    row_group_bytes: int = 128 << 20
    max_generations: int = 64
    retention_s: float = 7 * 86400.0

    def __post_init__(self):
        # zero or empty settings mean the default
        for name, default in (("flush_bytes", 4 << 20), ("rows_per_file", 5_000_000), ("bloom_fpp", 0.01), ("bloom_bytes", 1 << 20), ("row_group_bytes", 128 << 20), ("max_generations", 64)):
            if not getattr(self, name):
                object.__setattr__(self, name, default)


def open_store(spark: SparkSession, path: str, config: StoreConfig | None = None) -> Store:
    """The store at ``path``, made if there is none. Everything committed is there; nothing needs replaying."""
    return Store(spark, path, config or StoreConfig())


class Store:
    def __init__(self, spark: SparkSession, path: str, config: StoreConfig):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self.manifest = Manifest(spark, path)
        self._buffer: list[tuple] = []
        self._bytes = 0
        self._closed = False

    # --- writes -----------------------------------------------------------------------------------------------

    def insert(self, series_id: int, ts: int, value: bytes | None) -> None:
        """Upsert of one key; None is stored as an empty value. Committed with the next flush."""
        self._add(series_id, ts, False, bytes(value or b""))

    def delete(self, series_id: int, ts: int) -> None:
        """Tombstone for one key, whether or not it exists."""
        self._add(series_id, ts, True, None)

    def _add(self, series_id: int, ts: int, deleted: bool, value: bytes | None) -> None:
        if self._closed:
            raise ValueError("the store is closed")
        if not 0 <= series_id < 1 << 63 or not -(1 << 63) <= ts < 1 << 63:
            raise ValueError("series ids are 0 .. 2^63 - 1 and times signed 64-bit; see functions.keys for larger ids")
        self._buffer.append((series_id, ts, len(self._buffer), deleted, value))
        self._bytes += 17 if deleted else 16 + len(value)
        if self._bytes >= self.config.flush_bytes and len(self.flush().generations) > self.config.max_generations:
            try:
                self.settle()
            except CommitConflict:  # another compaction was faster
                pass

    def flush(self) -> Snapshot:
        """Commit all buffered writes as one generation; without any, nothing is written."""
        if not self._buffer:
            return self.manifest.read()
        rows, self._buffer, self._bytes = self._buffer, [], 0
        try:
            return self._commit(self._write_rows(rows))
        except Exception:
            self._buffer, self._bytes = rows + self._buffer, self._bytes + sum(17 if r[3] else 16 + len(r[4]) for r in rows)
            raise

    def append(self, df: DataFrame, transaction: tuple[str, int] | None = None) -> Snapshot:
        """Commit a table of writes (series_id, ts, seq, deleted, value) as one generation.

        seq orders the writes of one key inside this table; older commits are outranked in any case. transaction: a
        (name, number) that is applied once, however often it is retried.
        """
        if transaction and self.manifest.read().applied.get(transaction[0], -1) >= transaction[1]:
            return self.manifest.read()
        return self._commit(self._write(lww.latest(checked(canonical(df)))), transaction)

    def _commit(self, made: Generation, transaction: tuple[str, int] | None = None) -> Snapshot:
        def change(now: Snapshot, version: int) -> Snapshot | None:
            if transaction and now.applied.get(transaction[0], -1) >= transaction[1]:
                return None
            applied = now.applied | ({transaction[0]: transaction[1]} if transaction else {})
            if not made.rows and not transaction:
                return None
            added = (replace(made, gen=version),) if made.rows else ()
            return replace(now, generations=now.generations + added, applied=applied, operation="append")

        return self.manifest.commit(change)

    def _write(self, df: DataFrame) -> Generation:
        """Rows to a new folder, sorted by key. The folder is no part of the store until a commit names it.

        What the job counted on its way out must be what the files hold, which their footers say.
        """
        folder = uuid.uuid4().hex
        target = f"{self.path}/data/{folder}"
        sent = Observation()
        seen = [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("deleted").cast("long")), F.lit(0)).alias("tombstones")]
        seen += [f(c).alias(name) for name, f, c in (("first_series", F.min, "series_id"), ("last_series", F.max, "series_id"), ("first_ts", F.min, "ts"), ("last_ts", F.max, "ts"))]
        arranged = df.select(STORED.names).repartitionByRange(*KEY).sortWithinPartitions(*KEY)
        (
            arranged.observe(sent, *seen)
            .write.option("compression", "snappy")
            .option("maxRecordsPerFile", self.config.rows_per_file)
            .option("parquet.block.size", self.config.row_group_bytes)
            .option("parquet.bloom.filter.enabled#series_id", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .option("parquet.bloom.filter.candidates.number#series_id", 10)
            .option("parquet.bloom.filter.max.bytes", self.config.bloom_bytes)
            .option("parquet.bloom.filter.fpp#series_id", self.config.bloom_fpp)
            .option("parquet.page.write-checksum.enabled", "true")
            .parquet(target)
        )
        stats, back = sent.get, self._files([target]).count()
        if back != stats["rows"]:
            raise RuntimeError(f"wrote {stats['rows']} rows but read back {back}")
        return Generation(0, folder, **stats)

    def _write_rows(self, rows: list[tuple]) -> Generation:
        """Buffered writes to a new folder, the newest of each key, sorted by key. At most ``flush_bytes`` and one write: a job would take longer than the file."""
        newest = {(r[0], r[1]): r for r in rows}
        kept = [newest[k] for k in sorted(newest)]
        columns = [pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), _FILE, strict=True)]
        sink = pa.BufferOutputStream()
        pq.write_table(pa.Table.from_arrays(columns, schema=_FILE), sink, compression="snappy", write_page_checksum=True, write_page_index=True, store_schema=False)
        data = sink.getvalue()
        if (back := pq.read_metadata(pa.BufferReader(data)).num_rows) != len(kept):
            raise RuntimeError(f"wrote {len(kept)} rows but read back {back}")
        folder = uuid.uuid4().hex
        self.manifest.put(f"data/{folder}/part-00000.snappy.parquet", data.to_pybytes())
        times = [r[1] for r in kept]
        return Generation(0, folder, len(kept), sum(r[3] for r in kept), int(kept[0][0]), int(kept[-1][0]), int(min(times)), int(max(times)))

    # --- reads ------------------------------------------------------------------------------------------------

    def _files(self, folders: list[str]) -> DataFrame:
        """Page checksums are verified; a damaged file fails the job, whatever the session says about corrupt files."""
        reader = self.spark.read.schema(STORED).option("parquet.page.verify-checksum.enabled", "true")
        return reader.option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false").parquet(*folders)

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version that later reads can be pinned to; buffered writes are committed first if it is the newest."""
        if version is None:
            self.flush()
        return self.manifest.read(version)

    def log(self, at: Snapshot | None = None) -> DataFrame:
        """All stored writes with their generation, by the schema of a change log."""
        at = at or self.snapshot()
        if not at.generations:
            return self.spark.createDataFrame([], LOG)
        gens = {g.folder: g.gen for g in at.generations}
        stored = self._files([f"{self.path}/data/{f}" for f in gens])
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        lookup = F.create_map(*[F.lit(x) for pair in gens.items() for x in pair])
        return stored.withColumn("gen", F.element_at(lookup, folder)).select(LOG.names)

    def _near(self, series_id: int, start: int, end: int, at: Snapshot | None) -> DataFrame:
        """The log without generations that by the manifest hold nothing of the series in that time; their files are not opened."""
        at = at or self.snapshot()
        return self.log(replace(at, generations=tuple(g for g in at.generations if g.may_hold(series_id, start, end))))

    def get(self, series_id: int, ts: int, at: Snapshot | None = None) -> tuple[bytes | None, bool, bool]:
        """(value, found, deleted): live (v, True, False), tombstone (None, False, True), miss (None, False, False)."""
        at = at or self.snapshot()
        if not any(g.may_hold(series_id, ts, ts) for g in at.generations):
            return None, False, False
        row = lww.latest(self._near(series_id, ts, ts, at).where((F.col("series_id") == series_id) & (F.col("ts") == ts))).first()
        if row is None:
            return None, False, False
        return (None, False, True) if row.deleted else (bytes(row.value), True, False)

    def multi_get(self, keys: DataFrame, at: Snapshot | None = None) -> DataFrame:
        return lww.multi_get(self.log(at), keys)

    def scan(self, series_id: int, start: int, end: int, at: Snapshot | None = None) -> DataFrame:
        """Live rows of a series in [start, end], in time order."""
        return lww.scan(self._near(series_id, start, end, at), series_id, start, end)

    def live(self, at: Snapshot | None = None) -> DataFrame:
        return lww.live(self.log(at))

    def scan_iterator(self, series_id: int, start: int, end: int, at: Snapshot | None = None) -> Iterable[tuple[int, int, bytes]]:
        """The same rows one after another, fetched partition by partition."""
        for row in self.scan(series_id, start, end, at).toLocalIterator():
            yield row.series_id, row.ts, bytes(row.value)

    # --- maintenance ------------------------------------------------------------------------------------------

    def compact(self, major: bool = True, gens: Iterable[int] | None = None) -> Snapshot:
        """Rewrite generations to their newest writes: all, or the neighbouring ones in ``gens``.

        major drops tombstones and must include the oldest generation. Writers may append meanwhile; if others took
        one of the generations away, the compaction is given up.
        """
        at = self.snapshot()
        chosen = tuple(g for g in at.generations if gens is None or g.gen in set(gens))
        if gens is not None and {g.gen for g in chosen} != set(gens):
            raise ValueError("no such generation")
        if not chosen:
            return at
        first = at.generations.index(chosen[0])
        if at.generations[first : first + len(chosen)] != chosen:
            raise ValueError("only neighbouring generations can be compacted")
        if major and first:
            raise ValueError("a major compaction must include the oldest generation: older values would come back")
        part = self.log(replace(at, generations=chosen))
        there = self._files([f"{self.path}/data/{g.folder}" for g in chosen]).count()  # from footers
        if there != sum(g.rows for g in chosen):
            raise RuntimeError("a generation has lost rows; its compaction would make that final")
        made = replace(self._write(lww.compact(part, major)), gen=max(g.gen for g in chosen))

        def change(now: Snapshot, version: int) -> Snapshot:
            folders = now.folders
            if any(g.folder not in folders for g in chosen):
                raise CommitConflict("a generation has been replaced meanwhile")
            k = folders.index(chosen[0].folder)
            if now.generations[k : k + len(chosen)] != chosen or (major and k):
                raise CommitConflict("the generations are no longer neighbours")
            kept = (made,) if made.rows else ()
            return replace(now, generations=now.generations[:k] + kept + now.generations[k + len(chosen) :], operation="major" if major else "minor")

        return self.manifest.commit(change)

    def settle(self) -> Snapshot:
        """Keep the number of generations bounded: beyond ``max_generations``, the youngest are compacted into one (a minor compaction).

        At least half of the allowed number is taken, and older ones as long as they hold no more rows than all taken before,
        so a row is rewritten a logarithmic number of times.
        """
        gens = self.snapshot().generations
        if len(gens) <= self.config.max_generations:
            return self.manifest.read()
        taken, rows = 0, 0
        for g in reversed(gens):
            if taken > self.config.max_generations // 2 and g.rows > rows:
                break
            taken, rows = taken + 1, rows + g.rows
        return self.compact(major=False, gens=[g.gen for g in gens[len(gens) - taken :]])

    def commits(self, up_to: int | None = None) -> list[int]:
        """Numbers of the stored commits, oldest first; only those up to a version, if given."""
        return [v for v in self.manifest.versions() if up_to is None or v <= up_to]

    def drop_commits(self, up_to: int) -> list[int]:
        """Forget the commits up to a version, the newest of all excepted: nobody can be pinned to them any more.

        Rows stay: the newest commit names all that are live. Returns the numbers; what only they named goes with the next vacuum.
        """
        newest = (self.manifest.versions() or [0])[-1]
        gone = [v for v in self.commits(up_to) if v != newest]
        for v in gone:
            self.manifest.forget(v)
        return gone

    def vacuum(self, retention_s: float | None = None) -> list[str]:
        """Remove folders that no version within the retention names, and commits before it; returns the folders.

        The retention must be longer than the longest read and the longest write.
        """
        keep_s = self.config.retention_s if retention_s is None else retention_s
        limit = time.time() - keep_s
        versions = self.manifest.versions()
        states = [self.manifest.read(v) for v in versions]
        used: set[str] = set()
        for i, s in enumerate(states):
            replaced = states[i + 1].time if i + 1 < len(states) else float("inf")
            if replaced >= limit:
                used |= set(s.folders)
        gone = [f for f, changed in self.manifest.folders().items() if f not in used and changed < limit]
        for f in gone:
            self.manifest.remove(f)
        for i, s in enumerate(states[:-1]):
            if states[i + 1].time >= limit:  # oldest first and without gaps, whatever clocks say: see Manifest.newest
                break
            self.manifest.forget(s.version)
        return gone

    def recover(self) -> Snapshot:
        """The state after a crash: the newest complete commit. Folders of unfinished writes are vacuum's."""
        return self.manifest.read()

    def close(self) -> None:
        """Commit buffered writes; a second call does nothing."""
        if not self._closed:
            self.flush()
            self._closed = True

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_):
        self.close()
