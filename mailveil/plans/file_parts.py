"""Masking of text files in parts, so that no file needs to fit into a row.

A file is read line by line and put together again in chunks. Findings that hold white space
hold it between two digits, and names and neighbours join across spaces only; so a line break
without a digit on each side is a seam that no finding crosses. What the context of a finding
needs from before its chunk are a few words, which come along. The result does not depend on
the size of the chunks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailveil.functions.binding import built_once
from mailveil.functions.masking import PLACEHOLDERS, mask
from mailveil.functions.recognizers import Recognizer, registry
from mailveil.functions.spans import (
    CONTEXT_TOKENS, DEFAULT_THRESHOLD, detect, moved, no_spans, scored,
)
from mailveil.functions.text import decode_bytes
from mailveil.operators.people import person_spans
from mailveil.session import settle

CHUNK_CHARACTERS = 1 << 20
LINE_END = "\n"
LAST_WORDS = rf"^[^A-Za-z0-9]*+(?:[A-Za-z0-9]++[^A-Za-z0-9]*+){{0,{CONTEXT_TOKENS}}}+"


def read_lines(spark: SparkSession, source: str) -> DataFrame:
    """``(file, split, row, text)``: the lines of all files below a folder, as a written table.

    ``split`` is where the piece of a file begins that a task has read; lines of a piece are in
    the order of ``row``. Bytes that are no UTF-8 are dropped.
    """
    path = F.col("_metadata.file_path")
    root = source.rstrip("/") + "/"
    lines = (
        spark.read.option("lineSep", LINE_END).option("recursiveFileLookup", True).text(source)
        .select(F.substring_index(path, root, -1).alias("file"),
                F.col("_metadata.file_block_start").alias("split"),
                F.monotonically_increasing_id().alias("row"),
                decode_bytes(F.col("value").cast("binary")).alias("text")))
    return settle(lines, "lines")


def chunk_keys(lines: DataFrame, size: int) -> DataFrame:
    """``(file, split, row, chunk_split, chunk)``: the chunk of each line.

    A chunk begins in a piece of a file, at its first line or after about ``size`` characters,
    but only at a seam; the lines before the first seam of a piece belong to the last chunk
    of the pieces before. Windows reach over the lines of a piece or the pieces of a file.
    """
    within = Window.partitionBy("file", "split").orderBy("row")
    slim = lines.select(
        "file", "split", "row", F.length("text").alias("n"),
        F.rlike("text", F.lit("^[0-9]")).alias("digit_first"),
        F.rlike("text", F.lit(r"[0-9]\z")).alias("digit_last"))
    pieces = slim.groupBy("file", "split").agg(F.max_by("digit_last", "row").alias("ended"))
    earlier = Window.partitionBy("file").orderBy("split")
    pieces = pieces.select("file", "split", F.coalesce(
        F.lag("ended").over(earlier), F.lit(False)).alias("ended_before"))
    before = F.sum("n").over(within) - F.col("n")
    marked = (
        slim.join(pieces, ["file", "split"])
        .withColumn("seam", ~(F.col("digit_first") & F.coalesce(
            F.lag("digit_last").over(within), F.col("ended_before"))))
        .withColumn("step", F.floor(before / F.lit(size)))
        .withColumn("begins", F.col("seam") & (
            F.coalesce(F.lag("step").over(within), F.lit(-1)) < F.col("step")))
        .withColumn("chunk", F.sum(F.col("begins").cast("int")).over(within)))
    last = F.when(F.max("chunk") > 0, F.struct(
        F.col("split").alias("chunk_split"), F.max("chunk").alias("chunk")))
    owners = (
        marked.groupBy("file", "split").agg(last.alias("last"))
        .select("file", "split", F.last("last", ignorenulls=True).over(
            earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("owner")))
    return marked.join(owners, ["file", "split"]).select(
        "file", "split", "row",
        F.when(F.col("chunk") > 0, F.col("split")).otherwise(F.col("owner.chunk_split"))
        .alias("chunk_split"),
        F.when(F.col("chunk") > 0, F.col("chunk")).otherwise(F.col("owner.chunk"))
        .alias("chunk"))


def last_words(text: Column) -> Column:
    """The last words of a text, the last one first and each spelled backwards."""
    # Java goes on to the end of a text that it splits, whatever the limit, so what holds those
    # words is taken first.
    end = F.regexp_extract(F.reverse(text), LAST_WORDS, 0)
    words = F.filter(F.split(end, "[^A-Za-z0-9]+", -1), lambda w: w != "")
    return F.slice(words, 1, CONTEXT_TOKENS)


def with_context(chunks: DataFrame) -> DataFrame:
    """Add ``context``: the last words of the file before each chunk, on a line of their own."""
    key = ["file", "chunk_split", "chunk"]
    in_file = Window.partitionBy("file").orderBy("chunk_split", "chunk")
    tails = chunks.select(*key, last_words(F.col("text")).alias("words"))
    counted = tails.withColumn("place", F.sum((F.size("words") > 0).cast("int")).over(in_file))
    # Each of these has a word at least, so as many of them as words are enough.
    near = Window.partitionBy("file").orderBy("place").rowsBetween(1 - CONTEXT_TOKENS, 0)
    held = counted.filter(F.size("words") > 0).select(
        "file", F.col("place").alias("before"),
        F.slice(F.flatten(F.reverse(F.collect_list("words").over(near))), 1, CONTEXT_TOKENS)
        .alias("words"))
    places = counted.select(
        *key, (F.col("place") - (F.size("words") > 0).cast("int")).alias("before"))
    written = F.concat(F.array_join(F.transform(F.reverse("words"), F.reverse), " "),
                       F.lit(LINE_END))
    contexts = places.join(held, ["file", "before"]).select(*key, written.alias("context"))
    return chunks.join(contexts, key, "left").withColumn(
        "context", F.coalesce("context", F.lit("")))


@built_once
def _found_column(recognizers: tuple[Recognizer, ...]) -> Column:
    return detect(F.col("text"), recognizers)


@built_once
def _masked_column(recognizers: tuple[Recognizer, ...], threshold: float,
                   replacements: tuple[tuple[str, str], ...]) -> Column:
    start = F.length("context")
    spans = scored(F.concat("context", "text"), moved(F.col("_spans"), start), recognizers,
                   threshold)
    return mask(F.col("text"), moved(spans, -start), dict(replacements))


def mask_parts(spark: SparkSession, source: str, names: DataFrame | None = None,
               recognizers: Sequence[Recognizer] | None = None,
               threshold: float = DEFAULT_THRESHOLD,
               replacements: Mapping[str, str] = PLACEHOLDERS,
               size: int = CHUNK_CHARACTERS) -> DataFrame:
    """``(file, chunk_split, chunk, masked)``: the files below a folder, masked in chunks that
    stand in this order, a line break between two.

    With ``names``, a table as ``names_table`` gives it, names of people are found too.
    Recognizers of the caller's own must not find anything across a line break.
    """
    recognizers = tuple(registry() if recognizers is None else recognizers)
    key = ["file", "chunk_split", "chunk"]
    lines = read_lines(spark, source)
    keys = chunk_keys(lines, size)
    text = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("split", "row", "text"))), lambda r: r["text"]),
        LINE_END)
    chunks = settle(lines.join(keys, ["file", "split", "row"]).groupBy(*key).agg(
        text.alias("text")), "chunks")
    found = with_context(chunks).withColumn("_spans", _found_column(recognizers))
    if names is not None:
        named = chunks.select(F.concat_ws("/", "chunk_split", "chunk", "file").alias("msg_seq"), "text")
        people = person_spans(named, names)
        found = found.withColumn("msg_seq", F.concat_ws("/", "chunk_split", "chunk", "file")).join(
            people, "msg_seq", "left").withColumn(
            "_spans", F.concat("_spans", F.coalesce("people", no_spans())))
    return found.select(*key, _masked_column(
        recognizers, threshold, tuple(replacements.items())).alias("masked"))


def numbered_lines(parts: DataFrame) -> DataFrame:
    """``(file, line, text)``: the lines of masked files, numbered from 1."""
    in_file = Window.partitionBy("file").orderBy("chunk_split", "chunk")
    cut = parts.withColumn("_lines", F.split("masked", LINE_END, -1)).drop("masked")
    cut = settle(cut, "masked-lines")
    starts = cut.select("file", "chunk_split", "chunk", F.size("_lines").alias("n")).select(
        "file", "chunk_split", "chunk", (F.sum("n").over(in_file) - F.col("n")).alias("before"))
    return (
        cut.join(starts, ["file", "chunk_split", "chunk"])
        .select("file", "before", F.posexplode("_lines").alias("place", "text"))
        .select("file", (F.col("before") + F.col("place") + 1).cast("bigint").alias("line"), "text"))


def mask_folder(spark: SparkSession, source: str, target: str, **options) -> None:
    """Write the masked files below a folder: for each a folder ``file=...`` of text files,
    whose names are in the order of the text. ``options`` are those of ``mask_parts``.

    Every line ends in a line break, whether or not the last one did.
    """
    key = ["file", "chunk_split", "chunk"]
    (mask_parts(spark, source, **options).repartitionByRange(*key).sortWithinPartitions(*key)
     .select("file", F.col("masked").alias("value"))
     .write.mode("overwrite").partitionBy("file").text(target))
