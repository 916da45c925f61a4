"""Mask whole text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailveil.functions.recognizers import registry
from mailveil.functions.text import decode_bytes
from mailveil.plans.texts import mask_texts


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` per file; files are read as bytes, so bad UTF-8 does not stop a run."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", decode_bytes(F.col("content")).alias("text"))


def mask_files(spark: SparkSession, source: str, target: str, synthetic: bool = False) -> None:
    """Write one masked text per file that is not blank, as ``(path, text)`` rows."""
    texts = read_texts(spark, source)
    masked = mask_texts(texts, F.col("path"), synthetic=synthetic, recognizers=registry())
    masked.select("path", F.col("masked").alias("text")).write.mode("overwrite").parquet(target)
