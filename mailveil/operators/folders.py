"""Filters by class and folder, and limits per folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Message classes that are no mail.
CALENDAR_CLASSES = ("IPM.Appointment", "IPM.Schedule.Meeting", "IPM.Task", "IPM.Activity")
# First messages of a folder are ranked within ranges of this many sequence values first.
RANK_RANGE = 100_000


def is_calendar(message_class: Column) -> Column:
    upper = F.upper(F.coalesce(message_class, F.lit("")))
    return reduce(lambda a, b: a | b,
                  [F.startswith(upper, F.lit(c.upper())) for c in CALENDAR_CLASSES])


def drop_calendar(mail: DataFrame) -> DataFrame:
    return mail.filter(~is_calendar(F.col("message_class")))


def list_folders(mail: DataFrame) -> DataFrame:
    """``(folder, messages, all_messages)``: every folder of the tree, with its own mail and
    that of the folders below it.

    A folder without mail of its own is known from those below. Each message counts for all
    folders above it before the one shuffle, where a folder is one row per task.
    """
    parts = F.split("folder", r"\\", -1)
    above = F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda n: F.struct(
        F.array_join(F.slice("_parts", F.lit(1), n), "\\").alias("folder"),
        (n == F.size("_parts")).alias("own")))
    return (
        mail.filter(F.col("folder").isNotNull()).select(parts.alias("_parts"))
        .select(F.explode(above).alias("f")).groupBy("f.folder")
        .agg(F.count_if("f.own").alias("messages"), F.count("*").alias("all_messages"))
    )


def folder_matches(folder: Column, path: str) -> Column:
    """Every part of the path is a part of the folder, in any order and case."""
    wanted = F.array(*[F.lit(part.lower()) for part in path.strip("/").split("/")])
    parts = F.split(F.lower(folder), r"\\", -1)
    return F.size(F.array_except(wanted, parts)) == 0


def find_folder(mail: DataFrame, path: str) -> DataFrame:
    """One row: the smallest name of a folder that matches."""
    return mail.filter(folder_matches(F.col("folder"), path)).agg(F.min("folder").alias("folder"))


def first_messages(mail: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` messages that are no calendar items; all if ``n`` is null."""
    kept = drop_calendar(mail)
    return kept if n is None else kept.orderBy("msg_seq").limit(n)


def read_folder(mail: DataFrame, path: str, n: int | None = None) -> DataFrame:
    """Messages of the folder a path names, the first ``n`` if a number is given."""
    target = find_folder(mail, path).scalar()
    return first_messages(mail.filter(F.col("folder") == target), n)


def first_per_folder(mail: DataFrame, n: int) -> DataFrame:
    """``(folder, msg_seq, place)`` of the first ``n`` messages of each folder.

    Only two slim columns are ranked, and in two steps: a folder with a large share of
    all mail is first cut down within ranges of the sequence.
    """
    slim = drop_calendar(mail).select("folder", "msg_seq")
    ranged = slim.withColumn("_range", F.call_function("div", F.col("msg_seq"), F.lit(RANK_RANGE)))
    within = Window.partitionBy("folder", "_range").orderBy("msg_seq")
    candidates = ranged.withColumn("_place", F.row_number().over(within)).filter(F.col("_place") <= n)
    # A range is needed only if the ranges before it do not hold n messages yet.
    sizes = candidates.groupBy("folder", "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("folder").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    needed = (
        sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .filter(F.col("_before") < n).drop("_n")
    )
    return (
        candidates.join(needed, ["folder", "_range"])
        .withColumn("place", (F.col("_before") + F.col("_place")).cast("bigint"))
        .filter(F.col("place") <= n)
        .select("folder", "msg_seq", "place")
    )


def folder_messages(mail: DataFrame, n: int | None = None) -> DataFrame:
    """Messages of each folder, all or the first ``n`` of each with their ``place``.

    The join key is unique per message.
    """
    if n is None:
        return drop_calendar(mail)
    chosen = first_per_folder(mail, n).select("msg_seq", "place")
    return mail.join(chosen, "msg_seq")
