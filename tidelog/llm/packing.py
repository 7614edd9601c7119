"""Packing tokenized documents into sequences by bounded-space online best fit.

Each partition keeps ``windows`` open sequences. A document longer than a sequence first fills whole ones; what
remains goes into the open window that it fills best. When it fits none, the fullest window is emitted and a new
one opened. Windows still open at the end of a partition are merged: the pieces of ``merge_fan`` partitions are packed
again, best fit from the largest down, and those of sequences that stay short are joined and cut. A merging task gets
at most ``merge_fan * windows`` sequences at any size of input.

A piece carries its place and a CRC of its ids; only pieces of windows left open carry the ids themselves.

Results by case: a null or empty text has no ids of its own, only the end id; very long texts fill whole sequences;
repeated rows and null ids are packed as rows of their own (their doc_id tells them apart no further); an empty
table gives no pieces; columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick, slices

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int, ids binary"
#: Ids of merged sequences lie above those of all partitions.
MERGED = 1 << 62
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int32()), ("ids", pa.binary())])


class OpenWindows:
    """At most ``most`` open sequences; ``put`` returns where a piece went and which window had to close for it."""

    def __init__(self, size: int, most: int, first_id: int):
        self.size, self.most, self.next_id = size, most, first_id
        self.free: list[tuple[int, int]] = []  # (room left, id), sorted: the tightest fit is the first that is large enough
        self.fill: dict[int, int] = {}

    def put(self, length: int) -> tuple[int, int, int | None]:
        """(window, offset in it, window closed without being full, or None)."""
        closed = None
        at = bisect_left(self.free, (length, -1))
        if at == len(self.free):
            if len(self.free) >= self.most:
                closed = self.free.pop(0)[1]
            room, w = self.size, self.next_id
            self.next_id += 1
            self.fill[w] = 0
        else:
            room, w = self.free.pop(at)
        offset = self.fill[w]
        self.fill[w] = offset + length
        if room > length:
            insort(self.free, (room - length, w))
        return w, offset, closed


def _pack_partition(encode: Callable[[list[str]], list[bytes]], size: int, most: int):
    """Partition function: Arrow batches of (doc_id, text) to pieces; ``encode`` gives each text's ids as uint32 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        space = OpenWindows(size, most, part << 32)
        held: dict[int, list[tuple]] = {}  # pieces of windows that are open
        for batch in slices(batches, 1):
            out: list[tuple] = []
            docs = encode([x or "" for x in batch.column(1).to_pylist()])
            for doc_id, ids in zip(batch.column(0).to_pylist(), docs, strict=True):
                n, start = len(ids) // 4, 0
                while n - start >= size:
                    out.append((doc_id, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, space.next_id, 0, part, None))
                    space.next_id += 1
                    start += size
                if length := n - start:
                    w, offset, closed = space.put(length)
                    held.setdefault(w, []).append((doc_id, start, length, zlib.crc32(rest := ids[4 * start :]), n, w, offset, part, rest))
                    for done in (closed, w if space.fill[w] == size else None):
                        if done is not None:
                            del space.fill[done]
                            out += [(*p[:-1], None) for p in held.pop(done)]
            if out:
                yield _batch(out)
        if held:
            yield _batch([p for pieces in held.values() for p in pieces])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def merge_open(pieces: pd.DataFrame, size: int, fan: int) -> pd.DataFrame:
    """Pieces of one group's open windows packed anew. Sequences less than 15/16 full are joined and cut at ``size``."""
    rows = sorted(pieces.itertuples(index=False), key=lambda p: (-p.length, p.part, p.sequence_id, p.offset))
    space = OpenWindows(size, len(rows) + 1, MERGED | fan << 32)
    placed = [(p, *space.put(p.length)[:2]) for p in rows]
    full = {w for w, fill in space.fill.items() if fill >= size - size // 16}
    out = [(p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens, w, offset, p.part, None) for p, w, offset in placed if w in full]
    w, at = space.next_id, 0
    for p in [p for p, window, _ in placed if window not in full]:
        start = 0
        while start < p.length:
            if at == size:
                w, at = w + 1, 0
            n = min(size - at, p.length - start)
            out.append((p.doc_id, p.start + start, n, zlib.crc32(p.ids[4 * start : 4 * (start + n)]), p.doc_tokens, w, at, p.part, None))
            start += n
            at += n
    return pd.DataFrame(out, columns=_ARROW.names).astype({"doc_id": "Int64"})


def pack(
    df: DataFrame, encode: Callable[[list[str]], list[bytes]], *, size: int = 2048, windows: int = 256, merge_fan: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all of ``df``'s rows.

    encode: texts to their ids, each as little-endian uint32 bytes, end id included. windows: open sequences per
    partition. merge_fan: partitions whose leftovers are merged in one task.
    """
    rows = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    # written once: tokens are counted once, and a piece's partition can't change under a later retry
    made = materialize(rows.mapInArrow(_pack_partition(encode, size, windows), PIECE), "packed")
    left = made.where("ids IS NOT NULL").withColumn("fan", F.floor(F.col("part") / merge_fan))
    merged = left.groupBy("fan").applyInPandas(lambda g: merge_open(g, size, int(g["fan"].iloc[0])), PIECE)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return made.where("ids IS NULL").select(columns).unionByName(merged.select(columns))
