"""A cleaning pipeline over ``documents``: quality, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. The classifiers are fitted on bounded
samples of the labelled rows, as documented in ``tidelog.llm.queries``.

Cases, the same in the first three stages: rows keep all their columns, whatever these are called, and null ids; very long texts are
read whole; an empty table gives an empty one. Null and empty texts are scored like any other by the two filters, and all stay among
near duplicates. Repeated rows share a score, and one of them stays among near duplicates. Packing: a null or empty text is its end id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import minhash, packing, quality, toxicity
from tidelog.llm.common import materialize, table
from tidelog.llm.queries import ByteBpeEncoder, quality_model, toxicity_model
from tidelog.llm.tokenizer import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3."""
    return quality.keep_good(docs, quality_model(spark, sf_dir), threshold=0.3)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7."""
    return toxicity.keep_ordinary(docs, toxicity_model(spark, sf_dir), threshold=0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return minhash.keep_one(docs, shingle=5, threshold=80)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences of 2048 tokens."""
    return packing.pack(docs, ByteBpeEncoder(vocabulary("byte_bpe_50k.json"), 1), size=2048)


STAGES = [("quality", keep_quality), ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("packing", pack_sequences)]

#: SQL can't express fitted classifiers or byte-pair encoding. Tests compare each stage with its operator, and the operators with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
