"""The registered query of each operator: thin wrappers that derive the contract's columns from the operator's output."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, minhash, packing, quality, sharding, token_counts, topk, toxicity
from .common import Scratch, table
from .tokenizer import load, vocabulary


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded-load ring over all documents, no slack: counts at most one apart (law ``rows``)."""
    rows = sharding.bounded_ring(table(spark, sf_dir, "documents"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def bpe_digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, n_tokens and the SHA-256 of ids and decoded text of (doc_id, ids, decoded)."""
    ids = batch.column("ids")
    ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    numbers = list(map(str, ids.flatten().to_pylist()))
    texts = batch.column("decoded").to_pylist()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    spans = list(zip([0, *ends], ends, strict=False))
    made = [pa.array([hi - lo for lo, hi in spans], pa.int64()), pa.array([digest(" ".join(numbers[lo:hi])) for lo, hi in spans]), pa.array(map(digest, texts), pa.string())]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; digests of the operator's ids and texts."""
    return bpe.encode(table(spark, sf_dir, "documents"), decode_too=True, derive=bpe_digests, derived_ddl="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document against a limit of 512, and how much of it fits."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), limit=512)


class ByteBpeEncoder:
    """Texts to ids of byte_bpe_50k.json plus the end id, as uint32 bytes.

    The merges run in tiktoken on the same vocabulary; special strings in a text give their ids, as the tokenizers
    library does by default. Texts with long white space, on which tiktoken's pattern fails, are encoded by this package.
    """

    def __init__(self, path: str, end_id: int):
        self.path, self.end_id = path, end_id

    def __call__(self, texts: list[str]) -> list[bytes]:
        return _encoder(self.path, self.end_id)(texts)


@lru_cache(2)
def _encoder(path: str, end_id: int) -> Callable[[list[str]], list[bytes]]:
    from array import array

    from .tokenizer import byte_letters

    spec = load(path)
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec.vocab.items()}
    fast = tiktoken.Encoding("byte_bpe", pat_str=spec.pattern.pattern, mergeable_ranks=ranks, special_tokens=spec.specials)
    allowed, plain = set(spec.specials), fast.encode_ordinary
    tail = array("I", [end_id])
    blank = re.compile(r"\s{256}")

    def ids(t: str) -> array:
        if blank.search(t):
            return spec.ids(t)
        return array("I", fast.encode(t, allowed_special=allowed) if "<|" in t else plain(t))

    def run(texts: list[str]) -> list[bytes]:
        return [(ids(t) + tail).tobytes() for t in texts]

    return run


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), ByteBpeEncoder(vocabulary("byte_bpe_50k.json"), 1), size=2048)


#: Labelled rows that a classifier is fitted on at most, of the rarer and of the commoner class; their texts are whole.
SAMPLE_DOCS = {"toxic": (1500, 3000), "quality": (1000, 2000)}
#: UTF-8 bytes of those texts at most, by class: the driver holds the sample. Where texts are long, fewer are taken, each whole.
SAMPLE_BYTES = {"toxic": (8 << 20, 16 << 20), "quality": (6 << 20, 12 << 20)}


def labelled_sample(spark: SparkSession, sf_dir: str, label: str, fold: int, left_out: int) -> list[tuple[int, str]]:
    """(label, text) of a bounded sample, chosen by hash, of labelled rows outside the held-out fold.

    The held-out fold is ``crc32(doc_id as text) mod fold = left_out``. Nulls in labels or texts are no examples, nor is a
    text that does not fit what is left of its class's bytes.
    """
    few, many = SAMPLE_DOCS[label]
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("y")).where(crc_of_id() % fold != left_out)
    marks = marks.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    rare = 1 if label == "toxic" else 0
    order = F.xxhash64("doc_id")
    picked = marks.where(F.col("y") == rare).orderBy(order, "doc_id").limit(few).union(marks.where(F.col("y") == 1 - rare).orderBy(order, "doc_id").limit(many))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NOT NULL")
    keep = Scratch()
    found = keep(docs.join(F.broadcast(picked), "doc_id").select("y", "text", "doc_id"), "labelled")
    same = found.withColumn("h", F.xxhash64("text"))
    sizes = same.groupBy("y", "doc_id", "h").agg(F.sum(F.octet_length("text")).alias("n")).orderBy(order, "doc_id", "h").limit(few + many).collect()
    left, fit = dict(zip((rare, 1 - rare), SAMPLE_BYTES[label], strict=True)), []
    for r in sizes:
        if r.n <= left[r.y]:
            left[r.y] -= r.n
            fit.append((r.y, r.doc_id, r.h))
    if len(fit) < len(sizes):
        chosen = spark.createDataFrame(fit, same.select("y", "doc_id", "h").schema)
        found = same.join(F.broadcast(chosen), ["y", "doc_id", "h"])
    rows = [(r.y, r.text) for r in found.select("y", "text", "doc_id").orderBy(order, "doc_id", "text").limit(few + many).collect()]
    keep.end()
    return rows


def crc_of_id() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    rows = labelled_sample(spark, sf_dir, "toxic", 3, 1)
    return toxicity.fit([t for y, t in rows if y], [t for y, t in rows if not y])


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    rows = labelled_sample(spark, sf_dir, "quality", 5, 0)
    return quality.fit([t.encode() for _, t in rows], [y for y, _ in rows])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by compression distance."""
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return _decided(scored, crc_of_id() % 3 == 1, 0.7)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the byte network."""
    scored = quality.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return _decided(scored, crc_of_id() % 5 == 0, 0.3)


def _decided(scored: DataFrame, held_out, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat.collapse(table(spark, sf_dir, "conversations"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors found for every hundredth vector."""
    return ann.search(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty largest inner products for every twentieth vector."""
    return topk.search(table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of four-word shingles are alike to four fifths."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, threshold=80)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_sharding, op3_bpe, op4_token_counts, op5_chat, op6_ann, op7_packing, op8_topk, op9_quality, op10_minhash)
    return {f.__name__: f for f in found}


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 20
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
i AS (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 2))) AS pos FROM w WHERE len(words) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 3], ' ') AS shingle FROM i),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 100 * k >= 80 * (cx.n + cy.n - k)),
z AS (SELECT x AS a, y AS b FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, z.b FROM r JOIN z ON r.other = z.a),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(c.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN c ON c.doc_id = m.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_chat": chat.ORACLE, "op8_topk": OP8_SQL, "op10_minhash": OP10_SQL}
