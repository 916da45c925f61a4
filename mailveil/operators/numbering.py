"""Dense numbers over a whole table without one global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A bucket covers this many sequence values, which bounds its window task; a group
# covers this many buckets, which bounds the running sum over buckets.
BUCKET = 100_000
GROUP = 100_000


def _sum_before(column: str, window) -> Column:
    frame = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(frame), F.lit(0))


def dense_sequence(rows: DataFrame, seq: str, order: Sequence[str] | None = None,
                   out: str = "dense", bucket: int = BUCKET, group: int = GROUP) -> DataFrame:
    """Number rows 1, 2, ... by ``order`` (default ``seq``), where ``order`` starts with ``seq``.

    Rows are counted per range of ``seq``; a running sum of those counts gives each
    range its offset, and each range is numbered by itself. The result depends on the
    data alone, so a retried task gives the same numbers.
    """
    order = list(order or [seq])
    keyed = rows.withColumn("_bucket", F.call_function("div", F.col(seq), F.lit(bucket)))
    sizes = (
        keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
        .withColumn("_group", F.call_function("div", F.col("_bucket"), F.lit(group)))
    )
    groups = sizes.groupBy("_group").agg(F.sum("_n").alias("_group_n"))
    # One row per ten billion sequence values: small whatever the table.
    starts = groups.select(
        "_group", _sum_before("_group_n", Window.orderBy("_group")).alias("_group_start"))
    offsets = (
        sizes.withColumn(
            "_in_group", _sum_before("_n", Window.partitionBy("_group").orderBy("_bucket")))
        .join(starts, "_group")
        .select("_bucket", (F.col("_group_start") + F.col("_in_group")).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return (
        keyed.join(offsets, "_bucket")
        .withColumn(out, (F.col("_offset") + inside).cast("bigint"))
        .drop("_bucket", "_offset")
    )


def batch_of(dense: Column, size: int) -> Column:
    """Batch number, from 1, of a dense sequence number."""
    return F.call_function("div", dense + F.lit(size - 1), F.lit(size)).cast("bigint")


def number_batches(messages: DataFrame, size: int = 5000, **bounds) -> DataFrame:
    """``(msg_seq, dense, batch)`` of the kept messages, in scan order."""
    dense = dense_sequence(messages.select("msg_seq"), "msg_seq", **bounds)
    return dense.withColumn("batch", batch_of(F.col("dense"), size))


def summarize_batches(batches: DataFrame) -> DataFrame:
    return batches.groupBy("batch").agg(F.count("*").alias("messages"))
