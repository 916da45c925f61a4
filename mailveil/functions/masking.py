"""Replace findings by placeholders."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailveil.functions.binding import let
from mailveil.functions.folding import cut_out
from mailveil.functions.spans import merge_adjacent, resolve

# Placeholder of each entity. An entity that has none is removed.
PLACEHOLDERS = {
    "PERSON": "<<PERSON>>",
    "EMAIL_ADDRESS": "<<EMAIL>>",
    "IP_ADDRESS": "<<IP>>",
    "AU_MOBILE": "<<AU_MOBILE>>",
    "AU_MOBILE_INT": "<<AU_MOBILE_INT>>",
    "AU_LANDLINE": "<<AU_LANDLINE>>",
    "AU_LANDLINE_INT": "<<AU_LANDLINE_INT>>",
    "AU_13": "<<AU_13>>",
    "AU_1300": "<<AU_1300>>",
    "AU_1800": "<<AU_1800>>",
    "AU_TFN": "<<TFN_REDACTED>>",
    "AU_ABN": "<<ABN_REDACTED>>",
    "AU_MEDICARE": "<<MEDICARE_REDACTED>>",
    "AU_DRIVER_LICENSE": "<<DRIVER_LICENSE_REDACTED>>",
}


def operators(custom: Mapping[str, str] | None = None, defaults: Mapping[str, str] = PLACEHOLDERS) -> dict[str, str]:
    """The default replacements with the caller's on top."""
    return {**defaults, **(custom or {})}


def replace_spans(text: Column, ordered: Column, replacements: Mapping[str, str]) -> Column:
    """Write the replacement of each span; an overlapped span ends where the next starts."""
    table = F.create_map(*[F.lit(x) for pair in replacements.items() for x in pair])

    def rebuild(spans: Column) -> Column:
        def gap(span: Column, i: Column) -> Column:
            done = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
            return F.struct(done.alias("start"), span["start"].alias("end"))

        kept = cut_out(text, F.transform(spans, gap))
        written = F.transform(
            spans, lambda s: F.coalesce(F.try_element_at(table, s["entity"]), F.lit("")))
        tail = F.substr(text, F.element_at(spans, -1)["end"] + 1)
        return F.when(F.size(spans) == 0, text).otherwise(F.concat(
            F.array_join(F.zip_with(kept, written, lambda k, w: F.concat(k, w)), ""), tail))

    return let(ordered, rebuild)


def mask(text: Column, spans: Column, replacements: Mapping[str, str] = PLACEHOLDERS) -> Column:
    """Settle conflicts, join neighbours, replace."""
    return let(F.struct(text.alias("text"), spans.alias("spans")), lambda m: F.when(
        F.size(m["spans"]) == 0, m["text"]).otherwise(replace_spans(
            m["text"], merge_adjacent(m["text"], resolve(m["spans"])), replacements)))
