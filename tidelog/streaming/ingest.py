"""Streams of writes.

``ingest`` commits each micro-batch as a generation; the batch's number is stored with the commit, so a batch that is
retried after a crash is applied once. Arrival order wins whatever ``ts`` says; nothing is late. Many small batches do not
make ever more generations: beyond the store's bound the youngest are compacted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import KEY
from ..sources.manifest import CommitConflict
from ..sources.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, name: str = "ingest", *, once: bool = True) -> StreamingQuery:
    """Start writing a stream of (series_id, ts, seq, deleted, value) into the store.

    once: take what is there and stop; else run until stopped. name: of the stream, one per store and checkpoint.
    """

    def commit(batch: DataFrame, number: int) -> None:
        store.append(batch, transaction=(name, number))
        try:
            store.settle()
        except CommitConflict:  # another compaction was faster
            pass

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if once else writer).start()


def newest_per_key(stream: DataFrame) -> DataFrame:
    """The newest write of each key as a streaming aggregate, for update or complete mode.

    Its state is one row per key in the state store; a tombstone stays, since a later stream of older writes is possible.
    """
    newest = F.max_by(F.struct("deleted", "value"), "seq").alias("w")
    return stream.groupBy(*KEY).agg(newest, F.max("seq").alias("seq")).select(*KEY, "seq", "w.deleted", "w.value")
