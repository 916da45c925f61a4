"""Look values up in a table with one row per key, whatever the key's share of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot if it holds more than one part in this many of all rows. At most this
# many keys can, so the hot side of the lookup has a proven bound and may be broadcast.
HOT_PARTS = 1000


def hot_keys(counts: DataFrame, key: str, n: str = "n", parts: int = HOT_PARTS) -> DataFrame:
    """Keys with more than ``1/parts`` of all rows, from a table of counts per key."""
    total = counts.agg(F.sum(n)).scalar()
    return counts.filter(F.col(n) * F.lit(parts) > total).select(key)


def lookup(facts: DataFrame, dim: DataFrame, key: str, value: str, row_id: Column,
           hot: DataFrame) -> DataFrame:
    """Left join of ``facts`` with ``(key, value)`` of ``dim``.

    Rows of hot keys meet their value by broadcast and stay where they are. The others
    are joined by shuffle; a row that needs no partner there is spread by ``row_id``
    instead of piling up on its key.
    """
    hot_dim = (
        dim.select(key, value).join(F.broadcast(hot), key, "left_semi")
        .select(F.col(key).alias("_hot_key"), F.col(value).alias("_hot_value"))
    )
    served = facts.join(F.broadcast(hot_dim), F.col(key) == F.col("_hot_key"), "left")
    settled = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    away = F.concat(F.lit("\x00"), row_id.cast("string"))
    served = served.withColumn("_join_key", F.when(settled, away).otherwise(F.col(key)))
    cold_dim = dim.select(F.col(key).alias("_join_key"), F.col(value).alias("_cold_value"))
    return (
        served.join(cold_dim, "_join_key", "left")
        .withColumn(value, F.coalesce("_hot_value", "_cold_value"))
        .drop("_join_key", "_hot_key", "_hot_value", "_cold_value")
    )
