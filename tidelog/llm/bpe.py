"""BPE encoding and decoding of whole documents with a public vocabulary.

Words are merged by the contiguous rank array (``tokenizer.merge_word``); ids leave Python as Arrow lists built from
the joined id bytes without copying. Decoding is what the tokenizers library does for a vocabulary without a decoder:
tokens joined by single spaces, special tokens kept.

Results by case: null and empty texts have no ids and decode to an empty text; ids outside the vocabulary are left
out when decoding; very long texts are encoded whole; repeated rows and null ids stay rows of their own; an empty
table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, slices
from .tokenizer import Bpe, load, vocabulary

VOCABULARY = "word_bpe_49k.json"
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_TEXT = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
_BOTH = pa.schema([*_IDS, ("decoded", pa.string())])


def _ids_array(docs: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(docs) + 1, np.int32)
    np.cumsum([len(d) // 4 for d in docs], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(docs), np.int32)))


def _decode_column(bpe: Bpe, column: pa.ListArray) -> pa.Array:
    names = _names(bpe)
    column = column.fill_null([]) if column.null_count else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if column.flatten().null_count or (len(flat) and not 0 <= flat.min() <= flat.max() < len(names)):
        return pa.array([" ".join([bpe.by_id[i] for i in ids if i in bpe.by_id]) for ids in column.to_pylist()], pa.string())
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    words = names[flat].tolist()
    return pa.array([" ".join(words[lo:hi]) for lo, hi in zip([0, *ends], ends, strict=False)], pa.string())


@lru_cache(4)
def _names(bpe: Bpe) -> np.ndarray:
    """Token by id, up to the first id without one."""
    known = 0
    while known in bpe.by_id:
        known += 1
    return np.array([bpe.by_id[i] for i in range(known)], object)


def encode(
    df: DataFrame, vocabulary_path: str | None = None, *, decode_too: bool = False, derive: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, derived_ddl: str = "",
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id and ids of every row; with ``decode_too`` also the text that the ids decode to, in the same pass.

    derive: what to make of these columns, batch by batch, where the caller wants less than ids and texts back;
    its columns are those of ``derived_ddl``.
    """
    path = vocabulary_path or vocabulary(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches, 1, 1 << 20):
            ids = _ids_array([bpe.id_bytes(x or "") for x in batch.column(1).to_pylist()])
            columns = [batch.column(0), ids]
            out = pa.RecordBatch.from_arrays([*columns, _decode_column(bpe, ids)], schema=_BOTH) if decode_too else pa.RecordBatch.from_arrays(columns, schema=_IDS)
            yield derive(out) if derive else out

    rows = pick(df, doc_id=id_col, text=text_col)
    ddl = derived_ddl if derive else "doc_id long, ids array<int>" + ", decoded string" * decode_too
    return rows.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, ddl)


def decode(df: DataFrame, vocabulary_path: str | None = None, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids; null ids give an empty text."""
    path = vocabulary_path or vocabulary(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _decode_column(bpe, batch.column(1))], schema=_TEXT)

    rows = pick(df, doc_id=id_col, ids=ids_col)
    return rows.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(ids AS ARRAY<INT>) AS ids").mapInArrow(run, "doc_id long, text string")
