"""Helpers that several of the operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType, VariantType

# A group is hot if it holds more than one part in this many of all rows. At most this many
# groups can, which bounds what hot_join broadcasts.
HOT_PARTS = 1000

# Bytes of text that a Python task turns into arrays at a time.
BLOCK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def with_columns(rows: DataFrame, ddl: str) -> StructType:
    """The schema of the rows with more columns at the end."""
    return StructType([*rows.schema.fields, *StructType.fromDDL(ddl)])


def hot_join(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str,
             total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per key in ``groups``.

    ``size`` counts the rows of a group. Groups with more than ``total / HOT_PARTS`` rows
    meet their rows by broadcast, so those rows are never shuffled; the rest join by key.
    """
    keys = list(keys)
    hot = groups.filter(F.col(size) * F.lit(HOT_PARTS) > F.lit(total))
    cold = groups.filter(F.col(size) * F.lit(HOT_PARTS) <= F.lit(total))
    met = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti")
    return met.unionByName(rest.join(cold, keys))


def row_key(docs: DataFrame) -> list[Column]:
    """What tells the rows of a table of documents apart beside their id: a digest of the text."""
    return [F.unhex(F.sha2(whole_text().cast("binary"), 256)).alias("digest")]


def one_of_each(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``kept(doc_id, digest, rows)`` names, one for each.

    ``rows`` says how many rows repeat the id and text. Where that is more than one, a row
    with the smallest hash of its columns stands for all; each task sends one row of those.
    The names of rows are hashed, so the texts that meet them are not sorted.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"),
                        *[c.alias(f"_{i}") for i, c in enumerate(row_key(docs))])

    def named(part: DataFrame) -> DataFrame:
        slim = part.select(F.col("doc_id").alias("id"), "digest").hint("shuffle_hash")
        return keyed.join(slim, keyed["_id"].eqNullSafe(slim["id"])
                          & (keyed["_0"] == slim["digest"]), "left_semi")

    alone = named(kept.filter("rows = 1"))
    order = F.xxhash64(*[F.col(f"_row.`{f.name}`") for f in docs.schema.fields
                         if not isinstance(f.dataType, (MapType, VariantType))])
    repeated = named(kept.filter("rows > 1")).groupBy("_id", "_0").agg(
        F.min_by("_row", order).alias("_row"))
    return alone.select("_row.*").unionByName(repeated.select("_row.*"))


def text_blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES,
                text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one have about ``limit`` bytes; one longer
    text makes a batch of its own."""
    for batch in batches:
        offsets = batch.column(text)
        start, held = 0, 0
        lengths = pc.fill_null(pc.binary_length(offsets), 0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(lengths):
            yield batch.slice(start)
