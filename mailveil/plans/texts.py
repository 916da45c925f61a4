"""Masking of single texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailveil.functions.binding import built_once
from mailveil.functions.masking import PLACEHOLDERS, mask
from mailveil.functions.recognizers import Recognizer, registry
from mailveil.functions.spans import DEFAULT_THRESHOLD, detect, no_spans, scored
from mailveil.functions.synthetic import DEFAULT_SEED, fill_placeholders
from mailveil.operators.people import person_spans


def scored_spans(text: Column, recognizers: Sequence[Recognizer],
                 threshold: float = DEFAULT_THRESHOLD) -> Column:
    return scored(text, detect(text, recognizers), recognizers, threshold)


@built_once
def _spans_column(recognizers: tuple[Recognizer, ...], threshold: float) -> Column:
    return scored_spans(F.col("text"), recognizers, threshold)


@built_once
def _masked_column(replacements: tuple[tuple[str, str], ...]) -> Column:
    return mask(F.col("text"), F.col("_spans"), dict(replacements))


def mask_texts(texts: DataFrame, key: Column, synthetic: bool = False,
               recognizers: Sequence[Recognizer] | None = None, seed: int = DEFAULT_SEED,
               threshold: float = DEFAULT_THRESHOLD,
               replacements: Mapping[str, str] = PLACEHOLDERS,
               names: DataFrame | None = None) -> DataFrame:
    """Add ``masked`` to a table with a ``text`` column; blank texts are rejected.

    With ``names``, a table of ``name`` and ``n`` as ``names_table`` gives it, names of people
    are found as well; ``key`` must then be unique and integer.
    """
    recognizers = registry() if recognizers is None else recognizers
    kept = texts.filter(F.trim(F.col("text")) != "")
    # In steps: Spark resolves an expression level by level, and only so many of them.
    spans = kept.withColumn("_spans", _spans_column(tuple(recognizers), threshold))
    if names is not None:
        people = person_spans(kept.select(key.alias("msg_seq"), "text"), names)
        spans = spans.withColumn("_key", key).join(
            people.withColumnRenamed("msg_seq", "_key"), "_key", "left").withColumn(
            "_spans", F.concat("_spans", F.coalesce("people", no_spans())))
    masked = spans.withColumn("masked", _masked_column(tuple(replacements.items())))
    if synthetic:
        masked = masked.withColumn("masked", fill_placeholders(
            F.col("masked"), key, F.lit("text"), seed))
    return masked.select(*texts.columns, "masked")
