"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import whole_text

# Rows of a shard are numbered within this many parts of it; the parts' sizes then give each
# part its first number. Bounds the broadcast table to shards x SLOT_PARTS rows.
SLOT_PARTS = 4096


def hash_digits(key: Column, salt: str, digits: int) -> Column:
    """The first hexadecimal digits of md5 of key and salt, as a number."""
    joined = F.concat(key, F.lit(f":{salt}"))
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, digits), 16, 10).cast("bigint")


def shard_score(key: Column, shard: int, weight: float) -> Column:
    """What a shard bids for a key; the shard with the highest bid gets it.

    With u uniform in (0, 1), ``weight / -ln(u)`` makes shards win in proportion to weight,
    and a change to one shard moves keys only into or out of that shard.
    """
    u = (hash_digits(key, str(shard), 13) + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.struct((F.lit(float(weight)) / -F.log(u)).alias("bid"), F.lit(-shard).alias("turn"))


def assign_shards(rows: DataFrame, key: Column, weights: Sequence[float],
                  grown: Sequence[float] | None = None) -> DataFrame:
    """Add ``shard``, and ``grown_shard`` if weights of a larger set of shards are given.

    The key alone decides; a null key counts as the empty one. ``grown`` must start with
    ``weights``: only what the new shards win moves. Equal bids go to the lower shard.
    """
    key = F.coalesce(key.cast("string"), F.lit(""))
    if grown is not None and list(grown[: len(weights)]) != list(weights):
        raise ValueError("grown weights must start with the present ones")
    if any(w <= 0 for w in [*weights, *(grown or ())]):
        raise ValueError("weights must be positive")

    def winner(bids: list[Column]) -> Column:
        return F.greatest(*bids) if len(bids) > 1 else bids[0]

    out = rows.withColumn("_won", winner([shard_score(key, s, w) for s, w in enumerate(weights)]))
    if grown is not None:
        new = [shard_score(key, s, w) for s, w in list(enumerate(grown))[len(weights):]]
        out = out.withColumn("_grown", winner([F.col("_won"), *new]))
        out = out.withColumn("grown_shard", (-F.col("_grown.turn")).cast("int")).drop("_grown")
    return out.withColumn("shard", (-F.col("_won.turn")).cast("int")).drop("_won")


def number_slots(rows: DataFrame, group: str, key: Column, order: Sequence[str]) -> DataFrame:
    """Add ``slot``: numbers from 0 without gaps in each ``group``.

    Rows are numbered inside SLOT_PARTS hashed parts of a group, so no task sorts a whole
    group; ``rows`` is read twice and should be a written table. Rows that agree in key and
    ``order`` get their numbers in any order.
    """
    key = F.coalesce(key.cast("string"), F.lit(""))
    parted = rows.withColumn("_part", hash_digits(key, "slot", 3))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    first = (
        parted.groupBy(group, "_part").agg(F.count("*").alias("_n"))
        .withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(group, "_part", "_first")
    )
    inside = Window.partitionBy(group, "_part").orderBy(*order)
    numbered = parted.withColumn("_place", F.row_number().over(inside))
    return (
        numbered.join(F.broadcast(first), [group, "_part"])
        .withColumn("slot", (F.col("_first") + F.col("_place") - 1).cast("bigint"))
        .drop("_part", "_place", "_first")
    )


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document with its size, checksum, shard, slot and the shard that it would
    have with one more shard.

    A null text has no bytes and the checksum of the empty one; an empty table gives no
    rows; repeated rows each get a slot; other columns are not read.
    """
    text = whole_text()
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("bigint").alias("size"),
        F.crc32(text).cast("bigint").alias("text_crc32"),
    )
    placed = assign_shards(slim, F.col("doc_id"), [1.0] * shards, [1.0] * (shards + 1))
    placed = settle(placed, "shards")
    return number_slots(placed, "shard", F.col("doc_id"), ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
