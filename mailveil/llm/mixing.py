"""Mixing sources to target weights: repetition rates per source, and hashed draws.

A document is emitted ``floor(rate)`` times, and once more if a number drawn from its id and
text is below the rest of the rate. What a document gets depends on itself and its source's
rate alone, so runs agree whatever the partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import hot_join, whole_text

WORD = r"[^\x20\x09-\x0D]+"
# A source's documents are taken this often at most.
MOST_COPIES = 3
# Source weights in the order of the names, over and over.
WEIGHTS = (1, 2, 3)
DRAW_DIGITS = 13


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) that the document and the seed decide."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}:"), F.md5(text))
    digits = F.substring(F.md5(key), 1, DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(16 ** DRAW_DIGITS))


def cycled_weights(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Add ``weight``: the weights over and over, sources by code point and null last.

    Sources are numbered by ranges: each range is counted, and a number within it follows, so
    no task holds them all. The table of ranges has a row per partition.
    """
    order = F.col("source").asc_nulls_last()
    ranged = settle(sources.repartitionByRange(order).withColumn(
        "_range", F.spark_partition_id()), "sources")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    cycle = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    return (
        ranged.withColumn("_place", inside).join(F.broadcast(before), "_range")
        .withColumn("weight", F.get(cycle, F.pmod(
            F.col("_before") + F.col("_place") - 1, F.lit(len(weights))).cast("int")))
        .drop("_range", "_place", "_before"))


def share_out(sources: DataFrame, most: int) -> tuple[int, int]:
    """``(words, weight)`` that sources below their cap share by weight.

    What all sources hold is shared by weight; a source whose share would exceed ``most``
    times its size is held there, and the others share what is left, until none is above.
    Each round is one sum over the sources. Shares only grow, so a source once held stays.
    """
    total = F.col("source_size").cast("decimal(38,0)")
    whole = int(sources.agg(F.sum(total)).first()[0] or 0)
    words, weight, held = whole, None, -1
    while True:
        # words * w / weight > cap, in integers.
        above = F.lit(False) if weight is None else (
            F.col("weight").cast("decimal(38,0)") * F.lit(words).cast("decimal(38,0)")
            > total * F.lit(most * weight).cast("decimal(38,0)"))
        capped, count, left = sources.agg(
            F.sum(F.when(above, total)), F.count_if(above),
            F.sum(F.when(~above, F.col("weight")))).first()
        if count == held:
            return words, weight or 1
        words, weight, held = whole - most * int(capped or 0), int(left or 0), count
        if weight == 0:
            return 0, 1


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS,
                   most: int = MOST_COPIES) -> DataFrame:
    """``(source, source_size, n_docs, target, rate)`` for ``sizes(source, size)``.

    Targets add up to all words unless every source is at its cap. A source without words
    has target and rate 0.
    """
    sources = sizes.groupBy("source").agg(
        F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_docs"))
    sources = settle(cycled_weights(sources, weights), "source-weights")
    words, weight = share_out(sources, most)
    cap = F.col("source_size") * F.lit(float(most))
    target = F.least(cap, F.lit(float(words)) * F.col("weight") / F.lit(float(weight)))
    return sources.withColumn("target", target).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
        .otherwise(F.lit(0.0)))


def with_copies(rows: DataFrame, targets: DataFrame, total: int) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` to rows that have ``source`` and ``draw``."""
    # Null is a source like any other, so it needs a key that joins.
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    joined = hot_join(rows.withColumn("_key", key),
                      targets.withColumn("_key", key).drop("source", "weight"),
                      ["_key"], "n_docs", total)
    whole = F.floor("rate")
    once_more = F.col("draw") < F.col("rate") - whole
    return joined.withColumn(
        "copies", (whole + F.when(once_more, 1).otherwise(0)).cast("long")
    ).drop("_key", "n_docs", "rate", "draw")


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES,
             seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies.

    The size is the number of words, 0 for null, empty and blank texts. Rows that repeat id
    and text draw the same number. A null source is a source, the last; a null id is drawn
    by its text. Other columns are not read; an empty table gives no rows. Texts are read
    once and never move: their size and draw meet the slim table of sources.
    """
    slim = settle(docs.select(
        "doc_id", "source", count_words(whole_text()).alias("size"),
        draw(F.col("doc_id"), whole_text(), seed).alias("draw")), "mix-sizes")
    targets = settle(source_targets(slim, weights, most), "mix-targets")
    return with_copies(slim, targets, slim.count())


def mix_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES,
                  seed: str = "mix") -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, none included,
    with all its columns and ``copy``, the number of the copy from 0."""
    sizes = settle(docs.select("source", count_words(whole_text()).alias("size")), "mix-sizes")
    targets = settle(source_targets(sizes, weights, most), "mix-targets")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "source",
                       draw(F.col("doc_id"), whole_text(), seed).alias("draw"))
    taken = with_copies(rows, targets, sizes.count()).filter("copies > 0")
    return taken.select(
        "_row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    ).select("_row.*", "copy")


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    return mix_plan(docs).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"))
