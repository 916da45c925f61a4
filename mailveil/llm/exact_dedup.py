"""Exact deduplication by merging sorted runs of digests in a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import hot_join, one_of_each, whole_text

# In each round a run is merged with up to this many others, a power of two: as many binomial
# exchanges in one step.
FAN_IN = 64
# With more runs than FAN_IN ** ROUNDS several share a number, and the first round merges
# more of them at a time.
ROUNDS = 2

# Two texts count as equal if all of these agree: the digest, and as a check that does not
# depend on it the length and another hash.
KEY = ("digest", "n_bytes", "check_hash")


def digest_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A slim row per document, sorted by digest within its partition."""
    body = whole_text(text)
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"),
        F.octet_length(body).cast("bigint").alias("n_bytes"),
        F.xxhash64(body).alias("check_hash"),
    ).sortWithinPartitions(*KEY)


def merge_runs(runs: DataFrame, keep: Column, fan_in: int = FAN_IN,
               rounds: int = ROUNDS) -> DataFrame:
    """The groups of equal texts: ``keep_id`` and ``group_size`` for each key.

    A partition is a run. Each round joins neighbouring runs into one and keeps one row per
    key, so however many copies a text has, a run passes on one row of it. The work of a
    round is spread by run and key, not by run.
    """
    held = runs.select(*KEY, keep.alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
                       F.pmod(F.spark_partition_id(), F.lit(fan_in ** rounds)).alias("run"))
    for _ in range(rounds):
        held = (
            held.withColumn("run", F.floor(F.col("run") / F.lit(fan_in)).cast("int"))
            .groupBy("run", *KEY)
            .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        )
    return held.drop("run")


def exact_groups(docs: DataFrame, keep: str = "max", doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of documents with the same text the one with the largest (``keep="max"``) or smallest
    (``"min"``) id stays. Null texts are empty texts and so equal to each other. A null id
    is never kept unless its whole group has none. Rows that repeat id and text are one
    document in several rows: each counts in ``group_size`` and each is marked alike. Other
    columns are not read. An empty table gives no rows.
    """
    return exact_keys(docs, keep, doc_id, text).select(
        "doc_id", "keep_id", "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_keys(docs: DataFrame, keep: str, doc_id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """What ``exact_groups`` tells of each document, with the key of its text."""
    if keep not in ("max", "min"):
        raise ValueError("keep is 'max' or 'min'")
    runs = settle(digest_runs(docs, doc_id, text), "digests")
    total = runs.count()
    # The smallest id is the largest of the complements, and a complement never overflows.
    order = F.col("doc_id") if keep == "max" else F.bitwise_not("doc_id")
    groups = settle(merge_runs(runs, order), "digest-groups")
    if keep == "min":
        groups = groups.withColumn("keep_id", F.bitwise_not("keep_id"))
    return hot_join(runs, groups, KEY, "group_size", total).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_exact_copies(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The documents that stay, one row for each text, with all their columns.

    A row goes by its text and id, so neither a null id nor one that other texts repeat takes
    other rows along. Of rows that repeat id and text one stays, and of a text that has null
    ids only.
    """
    groups = settle(exact_keys(docs, keep), "exact-copies")
    # Rows that repeat the id that stays are marked alike; a row per text tells how many.
    kept = groups.filter("kept").groupBy("digest", "doc_id").agg(F.count("*").alias("rows"))
    return one_of_each(docs, settle(kept, "kept"))
