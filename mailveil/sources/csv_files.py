"""The batched CSV output and CSV previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from mailveil.functions.text import csv_safe

# The output columns, each with the record field it is written from.
CSV_COLUMNS = {
    "MessageId": "MessageId",
    "EmailReceivedDate": "EmailReceivedDate",
    "EmailFromMasked": "EmailFrom",
    "EmailToMasked": "EmailTo",
    "EmailCCMasked": "EmailCC",
    "SubjectMasked": "Subject",
    "EmailBodyMasked": "EmailBody",
    "SubjectSynthetic": "SubjectSynthetic",
    "EmailBodySynthetic": "EmailBodySynthetic",
    "OriginalSubject": "OriginalSubject",
    "OriginalEmailBody": "OriginalEmailBody",
    "PIIEntitiesFound": "PIIEntitiesFound",
    "PIICount": "PIICount",
    "NoOfAttachments": "NoOfAttachments",
    "ThreadMessageId": "ThreadMessageId",
    "ThreadId": "ThreadId",
    "ParentId": "ParentId",
    "References": "References",
    "ReplyDepth": "ReplyDepth",
}
UNSANITIZED = ("MessageId", "EmailReceivedDate", "PIICount", "NoOfAttachments", "ReplyDepth")
NUMBERS = ("PIICount", "NoOfAttachments", "ReplyDepth")
ORIGINALS = ("OriginalSubject", "OriginalEmailBody")


def csv_rows(record: DataFrame, drop_originals: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Message records as the CSV columns, all text; ``keep`` columns pass unchanged."""
    columns = []
    for name, source in CSV_COLUMNS.items():
        if drop_originals and name in ORIGINALS:
            continue
        value = F.col(source)
        value = F.coalesce(value.cast("string"), F.lit("")) if name in UNSANITIZED else csv_safe(value)
        columns.append(value.alias(name))
    return record.select(*keep, *columns)


def write_batches(record: DataFrame, path: str, base: str = "mail", drop_originals: bool = False) -> None:
    """One folder with one file per batch, ``batch={base}_batch0001`` and so on.

    ``record`` carries ``msg_seq`` and ``batch`` and is clustered by ``batch``. A batch has
    a fixed number of rows, so the tasks are even; batches without rows leave nothing
    behind. No field holds a line break or a double quote after cleaning.
    """
    rows = csv_rows(record, drop_originals, keep=("msg_seq", "batch"))
    named = rows.withColumn("batch", F.concat(
        F.lit(f"{base}_batch"), F.format_string("%04d", F.col("batch"))))
    (named.sortWithinPartitions("batch", "msg_seq").drop("msg_seq").write.mode("overwrite").partitionBy("batch")
     .option("header", True).option("quoteAll", True).option("escape", '"')
     .option("encoding", "UTF-8")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def csv_reader(spark: SparkSession) -> DataFrameReader:
    return (
        spark.read.option("header", True).option("escape", '"')
        .option("nullValue", "\x00").option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    )


def read_csv(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    """Any CSV files with a header; types are text, or inferred by one more pass over them."""
    return csv_reader(spark).option("inferSchema", infer).csv(path)


def read_batches(spark: SparkSession, path: str, drop_originals: bool = False) -> DataFrame:
    """Written batches, with the types that their columns have whatever they hold."""
    names = [c for c in CSV_COLUMNS if not (drop_originals and c in ORIGINALS)]
    kinds = [f"`{c}` {'long' if c in NUMBERS else 'string'}" for c in names]
    return csv_reader(spark).schema(", ".join([*kinds, "batch string"])).csv(path)


def preview(rows: DataFrame, n: int = 100, *order: str) -> DataFrame:
    """First rows by some columns, as files have no order of their own."""
    return rows.orderBy(*(order or ("MessageId",))).limit(n)
