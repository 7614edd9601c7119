"""Document quality by a convolutional network over bytes, in numpy.

Filters see ``width`` neighbouring bytes, one learned weight for each byte value and place. A text is cut into blocks;
two adjacent blocks are a chunk, so chunks overlap by half and cover the whole document. Each filter's response is
max-pooled over a chunk; the chunks' responses are averaged and combined into one probability by a logistic unit.
Only the maxima pass gradients back, so training touches few weights at a time and takes seconds on a bounded sample.

Results by case: null and empty texts are one chunk of zero bytes; very long texts are scored on all their chunks, in
segments of fixed size; repeated rows get equal scores; a null id stays null; an empty table gives an empty result;
without labelled texts of both classes every score is 0.5; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, ship, slices


@dataclass(frozen=True)
class Settings:
    """block: bytes; a chunk is two of them. batch: texts of a training step."""

    filters: int = 16
    width: int = 6
    block: int = 128
    epochs: int = 14
    batch: int = 64
    rate: float = 0.01
    seed: int = 5


@dataclass
class Model:
    settings: Settings
    tables: np.ndarray | None = None  # (width, 256, filters)
    bias: np.ndarray | None = None
    weights: np.ndarray | None = None
    offset: float = 0.0


SEGMENT = 128  # blocks convolved at a time


def _layout(texts: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one buffer, padded with zero bytes to whole blocks; the number of blocks of each.

    A filter at a place sees that byte and those before it. At least ``width - 1`` zero bytes follow a text and stand
    before the first, so no filter sees two texts.
    """
    counts = np.array([-(-(len(t) + s.width - 1) // s.block) for t in texts], np.int64)
    data = np.zeros(int(counts.sum()) * s.block + s.width, np.uint8)
    at = s.width - 1
    for t, n in zip(texts, counts, strict=True):
        data[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += int(n) * s.block
    return data, counts


def _block_maxima(m: Model, data: np.ndarray, blocks: int, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """(blocks, filters) largest responses, and where in the buffer their first bytes are. A filter may reach back into the block before."""
    s = m.settings
    out = np.empty((blocks, s.filters), np.float32)
    where = np.empty((blocks, s.filters), np.int64) if places else None
    room = np.empty((SEGMENT * s.block, s.filters), np.float32)
    for lo in range(0, blocks, SEGMENT):
        n = min(SEGMENT, blocks - lo) * s.block
        at = lo * s.block
        total = np.take(m.tables[0], data[at : at + n], axis=0)
        for k in range(1, s.width):
            total += np.take(m.tables[k], data[at + k : at + k + n], axis=0, out=room[:n], mode="clip")
        total = total.reshape(-1, s.block, s.filters)
        if places:
            best = total.argmax(axis=1)
            where[lo : lo + len(best)] = best + (np.arange(len(best))[:, None] * s.block + at)
            out[lo : lo + len(best)] = np.take_along_axis(total, best[:, None, :], 1)[:, 0]
        else:
            total.max(axis=1, out=out[lo : lo + len(total)])
    return out, where


def _chunks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second block of every chunk (the same if a text has one block), and the first chunk of each text."""
    ends = np.cumsum(counts)
    n = np.maximum(1, counts - 1)
    first = np.arange(int(n.sum())) + np.repeat((ends - counts) - (np.cumsum(n) - n), n)
    second = np.minimum(first + 1, np.repeat(ends - 1, n))
    return first, second, np.cumsum(n) - n


def scores(m: Model, texts: list[bytes]) -> np.ndarray:
    if m.tables is None or not texts:
        return np.full(len(texts), 0.5)
    data, counts = _layout(texts, m.settings)
    maxima, _ = _block_maxima(m, data, int(counts.sum()))
    first, second, starts = _chunks(counts)
    pooled = np.maximum(np.maximum(maxima[first], maxima[second]) + m.bias, 0)
    mean = np.add.reduceat(pooled, starts, axis=0, dtype=np.float64) / np.maximum(1, counts - 1)[:, None]
    return 1 / (1 + np.exp(-np.clip(mean @ m.weights + m.offset, -30, 30)))


def fit(texts: list[bytes], labels: list[int], settings: Settings = Settings()) -> Model:
    """Adam on the mean log loss; the sample stays as it is on the driver, a few megabytes."""
    s, y_all = settings, np.array(labels, np.float64)
    if len(set(labels)) < 2:
        return Model(s)
    rng = np.random.default_rng(s.seed)
    share = np.clip(y_all.mean(), 0.01, 0.99)
    m = Model(s, rng.normal(0, 0.3, (s.width, 256, s.filters)).astype(np.float32), np.zeros(s.filters, np.float32), rng.normal(0, 0.5, s.filters), float(np.log(share / (1 - share))))
    slow = {k: np.zeros_like(getattr(m, k)) for k in ("tables", "bias", "weights")}
    square = {k: np.zeros_like(v) for k, v in slow.items()}
    steps = 0
    for epoch in range(s.epochs):
        order = rng.permutation(len(texts))
        rate = s.rate * (1 - epoch / s.epochs)
        for lo in range(0, len(order), s.batch):
            ids = order[lo : lo + s.batch]
            data, counts = _layout([texts[i] for i in ids], s)
            maxima, where = _block_maxima(m, data, int(counts.sum()), places=True)
            first, second, starts = _chunks(counts)
            use = np.where(maxima[first] >= maxima[second], first[:, None], second[:, None])
            columns = np.arange(s.filters)
            raw = maxima[use, columns] + m.bias
            n = np.maximum(1, counts - 1)
            owner = np.repeat(np.arange(len(ids)), n)
            mean = np.add.reduceat(np.maximum(raw, 0), starts, axis=0) / n[:, None]
            p = 1 / (1 + np.exp(-np.clip(mean @ m.weights + m.offset, -30, 30)))
            error = (p - y_all[ids]) / len(ids)
            back = (error / n)[owner][:, None] * m.weights[None, :] * (raw > 0)
            grads = {"weights": error @ mean + 1e-4 * m.weights, "bias": back.sum(axis=0).astype(np.float32)}
            table = np.zeros_like(m.tables)
            spots = where[use, columns]
            for k in range(s.width):
                np.add.at(table[k], (data[spots + k], np.broadcast_to(columns, spots.shape)), back.astype(np.float32))
            grads["tables"] = table
            m.offset -= rate * float(error.sum())
            steps += 1
            for name, g in grads.items():
                slow[name] += 0.1 * (g - slow[name])
                square[name] += 0.01 * (g * g - square[name])
                step = slow[name] / (1 - 0.9**steps) / (np.sqrt(square[name] / (1 - 0.99**steps)) + 1e-8)
                setattr(m, name, (getattr(m, name) - rate * step).astype(g.dtype))
    return m


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: quality likelier) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(model, [x or b"" for x in batch.column(1).to_pylist()]))], schema=_OUT)

    rows = pick(df, doc_id=id_col, text=text_col)
    return rows.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(text AS BINARY) AS text").mapInArrow(run, "doc_id long, score double")


def keep_good(df: DataFrame, model: Model, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all their columns, whose text scores at least the threshold."""
    ship(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, 1 << 20):
            texts = [(x or "").encode() for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(scores(model, texts) >= threshold))

    return df.mapInArrow(run, df.schema)
