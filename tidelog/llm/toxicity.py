"""Toxicity by compression distance: does a dictionary of toxic text shorten a window more than one of ordinary text?

Fitting takes a bounded sample of labelled texts, dealt in five parts. Zstandard trains a dictionary on windows of ordinary
text, which both classes share, and for each of four parts of the sample one on toxic and one on ordinary windows.
Labels are of whole texts, though, and most windows of a toxic text are ordinary: those taken for training hold a word whose
beginning is many times as frequent in toxic texts as in ordinary ones, in that part and in the others. The last part, which
no dictionary has seen, calibrates thresholds on the windows of ordinary texts, and weights.

For scoring, a text is cut at white space into windows of some forty bytes, and where there is none also at a fixed size, with
an overlap. Every window of the whole text is compressed with each dictionary; the sum of ordinary length less toxic
length is its distance. A text's score is a logistic function of its largest distances and of how many windows exceed each threshold.

Results by case: null and empty texts, or texts of white space only, have one empty window and get the score of no
evidence; very long texts are scored on all their windows, a stretch at a time; repeated rows get equal scores; a null id stays null; an
empty table gives an empty result; without labelled texts of both classes every score is 0.5; a class with too little text to
train on gives that text as its dictionary; columns other than id and text are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import pick, ship, slices
from .logistic import fit_logistic

_PUNCTUATION = bytes.maketrans(b".,;:!?\"()|\n\t\r\v\f\x1c\x1d\x1e\x1f", b" " * 19)
_SPACES = re.compile(r"[^\S ]")
#: Bytes of a window at most, where a stretch has no white space, and what consecutive ones of it share.
LONGEST, OVERLAP = 128, 32
#: Characters of a text that are in work at a time.
STRETCH = 1 << 18


@dataclass(frozen=True)
class Settings:
    """window: bytes of a scored window at least; it ends at white space. shared, own: bytes of the common dictionary and of each
    class's. segment: bytes of a segment that the trainer picks. sample: bytes of a training window. each: training
    windows for one word beginning. share, ratio: a beginning marks toxic windows if it is in that share of the toxic
    texts and so many times as frequent as in ordinary ones. false_alarms: share of ordinary texts that may score 0.7."""

    window: int = 40
    shared: int = 65536
    own: int = 2048
    segment: int = 16
    sample: int = 6
    each: int = 300
    share: float = 0.03
    ratio: float = 8.0
    pairs: int = 4
    min_match: int = 6
    false_alarms: float = 0.008


@dataclass(frozen=True)
class Model:
    """dictionaries: (ordinary, toxic) of each pair, the shared one in front."""

    settings: Settings
    dictionaries: tuple[tuple[bytes, bytes], ...] = ()
    thresholds: tuple[float, ...] = ()
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    bias: float = 0.0


def _clean(text: str) -> bytes:
    text = text.lower()
    if not text.isascii():
        text = _SPACES.sub(" ", text)
    return b" " + text.encode().translate(_PUNCTUATION) + b" "


def stretches(text: str) -> Iterator[bytes]:
    """The cleaned text in parts that end at white space, or after some more characters where there is none."""
    start = 0
    while True:
        end = start + STRETCH
        stop = min(len(text), end + 256)
        while end < stop and not text[end].isspace():
            end += 1
        yield _clean(text[start:end])
        start = end
        if start >= len(text):
            return


def _apart(texts: list[str]) -> list[str]:
    """Those texts that do not repeat much of earlier ones: copies would count as evidence more than once."""
    seen: set[int] = set()
    out = []
    for t in texts:
        words = _clean(t).split()
        runs = {h for h in (zlib.crc32(b" ".join(words[i : i + 3])) for i in range(len(words) - 2)) if not h % 8}
        if not runs or len(runs & seen) <= len(runs) / 5:
            seen |= runs
            out.append(t)
    return out


def _beginnings(data: bytes) -> set[bytes]:
    return {w[:n] for w in data.split() if len(w) > 3 for n in (5, 6, 7, 8, 9, 10)}


def _counts(texts: list[str]) -> tuple[Counter, int]:
    found: Counter = Counter()
    for t in texts:
        found.update(_beginnings(_clean(t)))
    return found, sum(found.values())


def _marks(toxic: tuple[Counter, int], ordinary: tuple[Counter, int], least: float, ratio: float) -> dict[bytes, float]:
    """Word beginnings in at least so many toxic texts and so many times as frequent there, with their weights."""
    (mine, n), (other, m) = toxic, ordinary
    expected = {w: (other[w] + 0.5) * n / max(1, m) for w, k in mine.items() if k >= least}
    return {w: mine[w] * math.log(mine[w] / e) for w, e in expected.items() if mine[w] >= ratio * e}


def _windows(texts: list[bytes], size: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts as one buffer, (start, length) of every window, and the first window of each text.

    A window begins with white space and takes in the one that the next begins with.
    """
    data = b"".join(texts)
    a = np.frombuffer(data, np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    spaces = np.flatnonzero(a == 32)
    marks = np.concatenate([np.arange(lo + size, hi, size) for lo, hi in zip(np.r_[0, ends[:-1]], ends, strict=True)] or [np.empty(0, int)])
    cuts = spaces[np.searchsorted(spaces, marks)] if len(marks) else marks  # every text ends in white space
    cuts = cuts[~np.isin(cuts + 1, ends)]
    starts = np.unique(np.r_[0, ends[:-1], cuts]).astype(np.int64)
    limit = ends[np.searchsorted(ends, starts, side="right")]
    long = np.minimum(np.r_[starts[1:], len(a)] + 1, limit) - starts
    parts = np.maximum(1, -(-(long - OVERLAP) // (LONGEST - OVERLAP)))  # of a window above the longest size
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    stops = np.repeat(starts + long, parts)
    starts = np.repeat(starts, parts) + nth * (LONGEST - OVERLAP)
    stops = np.minimum(stops, starts + LONGEST)
    return data, np.stack([starts, stops - starts], 1).astype(np.uint64), np.searchsorted(starts, np.r_[0, ends[:-1]])


def _cut(texts: list[str], size: int) -> list[bytes]:
    data, windows, _ = _windows([p for t in texts for p in stretches(t)], size)
    return [data[a : a + n] for a, n in windows.astype(np.int64).tolist()]


def train(windows: list[bytes], size: int, s: Settings, filled: bool = False) -> bytes:
    """A dictionary of at most ``size`` bytes, trained by zstandard. Windows are mixed first: the trainer goes through them once.

    filled: where the trainer leaves room, windows themselves stand before what it chose, so that two dictionaries are equally long.
    """
    mixed = sorted(windows, key=zlib.crc32)
    try:
        made = zstandard.train_dictionary(size, mixed, k=s.segment, d=6, level=3).as_bytes()[-size:]
    except zstandard.ZstdError:  # too little text
        made, filled = b"", True
    room = size - len(made)
    return b"".join(mixed)[-room:] + made if filled and room else made


def toxic_windows(texts: list[str], marks: dict[bytes, float], s: Settings) -> list[bytes]:
    """Windows that hold a marked word beginning, at most ``each`` for the weightiest one in them, chosen by hash."""
    found: dict[bytes, list[bytes]] = {}
    for w in _cut(texts, s.sample):
        best = max(((marks[b], b) for b in _beginnings(w) if b in marks), default=None)
        if best:
            found.setdefault(best[1], []).append(w)
    return [w for those in found.values() for w in sorted(those, key=zlib.crc32)[: s.each]]


@lru_cache(32)
def _compressor(dictionary: bytes, min_match: int) -> zstandard.ZstdCompressor:
    # the fast strategy with a target length stores literals as they are, so lengths follow matches alone
    params = zstandard.ZstdCompressionParameters(
        window_log=19, hash_log=17, chain_log=17, search_log=5, min_match=min_match, target_length=1, strategy=zstandard.STRATEGY_FAST, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


def _lengths(dictionary: bytes, source: bytes, windows: bytes, s: Settings) -> np.ndarray:
    done = _compressor(dictionary, s.min_match).multi_compress_to_buffer(zstandard.BufferWithSegments(source, windows), threads=1)
    return np.fromiter(map(len, done), np.int32, len(done))


def distances(model: Model, texts: list[str]) -> list[np.ndarray]:
    """Per text, the distance of each window."""
    parts = [list(stretches(t)) if len(t) > STRETCH else [_clean(t)] for t in texts]
    out: list[list[np.ndarray]] = [[] for _ in texts]
    owners, held, size = [], [], 0

    def flush() -> None:
        data, windows, first = _windows(held, model.settings.window)
        where = windows.tobytes()
        total = sum(_lengths(o, data, where, model.settings) - _lengths(t, data, where, model.settings) for o, t in model.dictionaries)
        for owner, d in zip(owners, np.split(total, first[1:]), strict=True):
            out[owner].append(d.astype(np.int16))

    for i, those in enumerate(parts):
        for part in those:
            owners.append(i)
            held.append(part)
            size += len(part)
            if size >= 1 << 20:
                flush()
                owners, held, size = [], [], 0
        parts[i] = []
    if held:
        flush()
    return [np.concatenate(d) for d in out]


TOP = (1, 3, 8)
#: Of the ordinary texts' windows, below a threshold each.
QUANTILES = (0.9, 0.97, 0.99, 0.997, 0.999, 0.9997)


def features(model: Model, each: list[np.ndarray]) -> np.ndarray:
    rows = []
    for d in each:
        top = np.sort(d)[::-1]
        over = [int((d >= t).sum()) for t in model.thresholds]
        rows.append([*(math.log1p(max(0, int(top[:k].sum()))) for k in TOP), *map(math.log1p, over), *(math.sqrt(n / len(d)) for n in over), math.log1p(len(d))])
    return np.array(rows, np.float64).reshape(len(each), len(TOP) + 2 * len(model.thresholds) + 1)


def fit(toxic: list[str], ordinary: list[str], settings: Settings = Settings()) -> Model:
    """Dictionaries from all but the last part of the texts; thresholds and weights from that."""
    s = settings
    if not toxic or not ordinary:
        return Model(s)
    toxic, ordinary = _apart(toxic), _apart(ordinary)
    *t_parts, t_held = (toxic[i :: s.pairs + 1] for i in range(s.pairs + 1))
    *o_parts, o_held = (ordinary[i :: s.pairs + 1] for i in range(s.pairs + 1))
    windows = [_cut(part, s.sample) for part in o_parts]
    shared = train([w for part in windows for w in part[::2]], s.shared, s)
    calm = _counts([t for part in o_parts for t in part])
    made = []
    for i, part in enumerate(t_parts):
        rest = [t for j, other in enumerate(t_parts) if j != i for t in other]
        marks = _marks(_counts(part), calm, max(4, s.share * len(part)), s.ratio)
        again = _marks(_counts(rest), calm, max(3, s.share * len(rest) / 2), s.ratio)
        bad = train(toxic_windows(part, {w: v for w, v in marks.items() if w in again}, s), s.own, s, filled=True)
        good = train(windows[i][1::2], s.own, s, filled=True)
        size = min(len(bad), len(good))
        made.append((shared + good[len(good) - size :], shared + bad[len(bad) - size :]))
    return _calibrate(Model(s, tuple(made)), t_held or toxic, o_held or ordinary)


def _calibrate(model: Model, toxic: list[str], ordinary: list[str]) -> Model:
    """Thresholds from ordinary windows, weights by logistic regression, shifted if too many ordinary texts reached 0.7."""
    far, near = distances(model, toxic), distances(model, ordinary)
    calm = np.sort(np.concatenate(near))
    model = replace(model, thresholds=tuple(sorted({float(max(1, calm[min(len(calm) - 1, int(len(calm) * q))])) for q in QUANTILES})))
    x = np.concatenate([features(model, far), features(model, near)])
    mean, scale, weights, bias = fit_logistic(x, np.r_[np.ones(len(far)), np.zeros(len(near))])
    model = replace(model, mean=tuple(mean), scale=tuple(scale), weights=tuple(weights), bias=bias)
    limit = float(np.quantile(_logit(model, x[len(far) :]), 1 - model.settings.false_alarms))
    return replace(model, bias=bias - max(0.0, limit - math.log(0.7 / 0.3)))


def _logit(model: Model, x: np.ndarray) -> np.ndarray:
    return (x - np.array(model.mean)) / np.array(model.scale) @ np.array(model.weights) + model.bias


def scores(model: Model, texts: list[str]) -> np.ndarray:
    if not model.weights:
        return np.full(len(texts), 0.5)
    return 1 / (1 + np.exp(-np.clip(_logit(model, features(model, distances(model, texts))), -30, 30)))


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: toxic likelier) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(model, [x or "" for x in batch.column(1).to_pylist()]))], schema=_OUT)

    rows = pick(df, doc_id=id_col, text=text_col)
    return rows.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_ordinary(df: DataFrame, model: Model, *, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all their columns, whose text scores below the threshold."""
    ship(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, 1 << 20):
            keep = scores(model, [x or "" for x in batch.column(at).to_pylist()]) < threshold
            yield batch.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)
