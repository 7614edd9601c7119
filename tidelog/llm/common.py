"""What the operators of this package share: table access, scratch tables in the shared folder, Arrow mapping."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need no copy of their own."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = f"{shared_dir(spark)}/tidelog/{app}/{root.name}.zip"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(packed.getvalue()))
    finally:
        out.close()
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local one if all runs in this process; on a cluster each executor would write to a disk of its own,
    so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = at.get() if at.isDefined() else None
    if not found:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/tidelog-scratch"
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back, which cuts its lineage.

    A lost executor loses nothing of it, and later plans read it column by column. The folder is removed when
    the driver ends, through Hadoop's file system, so any store works.
    """
    return _written(df, name)[0]


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidelog/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_remove_all)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """The scratch tables of one call; those of other calls, which may run at the same time, are not touched."""

    def __init__(self) -> None:
        self.tables: list[tuple[DataFrame, str]] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        made, path = _written(df, name)
        self.tables.append((made, path))
        return made

    def drop(self, *those: DataFrame) -> None:
        """Remove tables that no plan reads any more."""
        for made, path in [x for x in self.tables if any(x[0] is t for t in those)]:
            _remove(path)
            self.tables = [x for x in self.tables if x[1] != path]

    def end(self, *kept: DataFrame) -> None:
        """Remove all but those, which stay until the driver ends."""
        self.drop(*[t for t, _ in self.tables if not any(t is k for k in kept)])


def _remove(path: str) -> None:
    for entry in [x for x in _made if x[1] == path]:
        _delete(*entry)
        _made.remove(entry)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_all() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have gone first; the folder is scratch
            return


#: Bits of a bitmap of hashes. Its table of 64-bit words, which is broadcast, has BITMAP / 64 rows at most at any size of the data.
BITMAP = 1 << 25


def bitmap(hashes: DataFrame) -> DataFrame:
    """(bitmap_word, bitmap_bits) of a one-column table of 64-bit hashes."""
    at = F.pmod(F.col(f"`{hashes.columns[0]}`"), F.lit(BITMAP).cast("long"))
    words = hashes.select(F.shiftrightunsigned(at, 6).alias("bitmap_word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")).alias("bit"))
    return words.groupBy("bitmap_word").agg(F.bit_or("bit").alias("bitmap_bits"))


def filtered(df: DataFrame, bits: DataFrame, hashed: Column, inside: bool = True, keep: str | None = None) -> DataFrame:
    """Rows of ``df``, which stay where they are, that may be among the bitmap's (inside), or that surely are not.

    The fuller the bitmap, the more rows pass that are not wanted; the caller joins what passes exactly. So it decides only
    how many rows move, never which are right. keep: a new column with the bitmap's word, which is never 0. A later semi or anti
    join whose condition reads it is not moved below this filter by the optimizer, which would shuffle all rows.
    """
    word, held = fresh(df, "bitmap_word"), fresh(df, "bitmap_bits")
    at = F.pmod(hashed, F.lit(BITMAP).cast("long"))
    words = bits.select(F.col("bitmap_word").alias(word), F.col("bitmap_bits").alias(held))
    there = F.coalesce(F.call_function("bit_get", F.col(held), at.bitwiseAND(63).cast("int")), F.lit(0).cast("byte")) == (1 if inside else 0)
    joined = df.join(F.broadcast(words), F.shiftrightunsigned(at, 6) == F.col(word), "inner" if inside else "left")
    return joined.where(there).select(*[F.col(f"`{c}`") for c in df.columns], *([F.col(held).alias(keep)] if keep else []))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about ``most`` bytes in ``column`` (one longer value stands alone)."""
    for batch in batches:
        rows = batch.num_rows
        if batch.nbytes <= most or rows <= 1:
            if rows:
                yield batch
            continue
        values = batch.column(column)
        start = size = 0
        for i in range(rows):
            n = len(values[i].as_buffer() or b"") if values[i].is_valid else 0
            if size and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names, so that other columns never clash: pick(df, doc_id="doc_id")."""
    ship(df.sparkSession)
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])
