"""The corpus pipeline: documents pass through the stages in order.

Each stage takes what its predecessor kept, as a written table, and drops rows; the last
one encodes what is left. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mailveil.llm.bpe import encode
from mailveil.llm.common import table
from mailveil.llm.decontamination import drop_contaminated
from mailveil.llm.exact_dedup import drop_exact_copies
from mailveil.llm.language_id import drop_unidentified
from mailveil.llm.simhash import drop_near_copies
from mailveil.session import settle

# Compression, fingerprints and merges cannot be said in SQL.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language is in doubt, go."""
    return drop_unidentified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return drop_exact_copies(docs, keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of at most 4 bits of their fingerprints join, the smallest id
    stays."""
    return drop_near_copies(docs, words=4, distance=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), size=10)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with digests of them and of the bytes they decode to."""
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                  public_tokenizers.PATTERN, digests=True).drop("text")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
