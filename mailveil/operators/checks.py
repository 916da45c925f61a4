"""Rejected messages, change flags and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reject_reason(message_id: Column, delivery_time: Column) -> Column:
    """Why a message cannot be processed, null if it can."""
    return (
        F.when(message_id.isNull() & delivery_time.isNull(), F.lit("no message id, no delivery time"))
        .when(message_id.isNull(), F.lit("no message id"))
        .when(delivery_time.isNull(), F.lit("no delivery time"))
    )


def with_errors(mail: DataFrame) -> DataFrame:
    """Add ``_error``: why a message is rejected, with what could not be read of it, if that is
    known (``_errors``); null where it is not."""
    reason = reject_reason(F.col("message_id"), F.col("delivery_time"))
    if "msg_seq" in mail.columns:
        reason = F.when(F.col("msg_seq").isNull(), F.concat_ws(
            ", ", F.lit("no sequence number"), reason)).otherwise(reason)
    if "_errors" in mail.columns:
        read = F.array_join("_errors", "; ")
        reason = F.when(reason.isNotNull() & (read != ""), F.concat(
            reason, F.lit(" ("), read, F.lit(")"))).otherwise(reason)
    return mail.withColumn("_error", reason)


def split_rejects(mail: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good and rejected messages."""
    checked = with_errors(mail)
    return (checked.filter(F.col("_error").isNull()).drop("_error"),
            checked.filter(F.col("_error").isNotNull()))


def pii_changed(record: DataFrame) -> Column:
    return ((record["Subject"] != record["OriginalSubject"])
            | (record["EmailBody"] != record["OriginalEmailBody"]))


def summarize(record: DataFrame) -> DataFrame:
    """One row: messages processed, and messages that masking changed."""
    return record.agg(F.count("*").alias("messages"),
                      F.count_if(pii_changed(record)).alias("messages_with_pii"))


def total_entities(tallies: DataFrame) -> DataFrame:
    """``(entity, findings, messages)`` from one row per message and entity.

    Each message has one row per entity, so counting rows counts messages: no distinct.
    """
    return tallies.groupBy("entity").agg(
        F.sum("n").alias("findings"), F.count("*").alias("messages"))
