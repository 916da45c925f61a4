"""The saved address mapping: CSV files with ``id, original_email, anonymized_email``.

Each run adds a folder of files with a manifest. Pairs are staged first and published by one
rename, so a run that ends early adds nothing, and one that is repeated adds its pairs once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailveil.functions.headers import normalize_email
from mailveil.operators.pseudonyms import MAPPING_COLUMNS
from mailveil.sources.runs import Files, publish, stage_folder

MAPPING_FILE_SCHEMA = "id bigint, original_email string, anonymized_email string"


def latest_rows(rows: DataFrame) -> DataFrame:
    """One row per normalised address; the highest id wins."""
    row = F.struct("id", "original_email", "anonymized_email")
    return (
        rows.withColumn("norm_email", normalize_email(F.col("original_email")))
        .groupBy("norm_email").agg(F.max_by(row, F.col("id")).alias("row"))
        .select("row.*", "norm_email").select(*MAPPING_COLUMNS)
    )


def empty_mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MAPPING_FILE_SCHEMA + ", norm_email string")


def create_mapping(spark: SparkSession, path: str) -> None:
    """A mapping that holds nothing but its header."""
    empty = spark.createDataFrame([], MAPPING_FILE_SCHEMA)
    empty.coalesce(1).write.mode("ignore").option("header", True).csv(path)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Published pairs, in folders of runs or beside them."""
    rows = (
        spark.read.schema(MAPPING_FILE_SCHEMA).option("recursiveFileLookup", True)
        .option("header", True).option("escape", '"').csv(path)
    )
    return latest_rows(rows)


def stage_mapping(new: DataFrame, path: str, run: str) -> None:
    """Write the pairs of a run where no reader looks."""
    (new.select("id", "original_email", "anonymized_email")
     .write.mode("overwrite").option("header", True).option("escape", '"')
     .csv(stage_folder(path, run)))


def append_mapping(new: DataFrame, path: str, run: str | None = None,
                   manifest: dict | None = None) -> None:
    """Add the pairs of a run; none if a run of that name has been published before.

    Pass written or checkpointed pairs, not a plan over ``path``.
    """
    spark, run = new.sparkSession, run or uuid.uuid4().hex
    if not Files(spark, path).exists(f"{path}/run-{run}"):
        stage_mapping(new, path, run)
        publish(spark, path, run, manifest or {})
