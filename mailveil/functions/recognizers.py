"""What to look for: the recognizers and their registry."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column

from mailveil.functions import checksums
from mailveil.functions.patterns import DIGITS, LETTERS, WIDE, WORD


@dataclass(frozen=True)
class Recognizer:
    """One entity: patterns with base scores, context words, optional validator.

    The flags only save work. ``literal`` is a text that every match contains.
    ``digit_edges``: matches start (after any ``+``) and end with a digit. ``numeric``:
    moreover they are six or more digits with at most one space or hyphen between two.
    ``dotted``: they are four or more digits with at most one full stop between two.
    ``opening``: a pattern of what is skipped before a match, for patterns that say
    themselves where a match may start.
    """

    entity: str
    patterns: tuple[tuple[str, float], ...]
    context: tuple[str, ...] = ()
    validator: Callable[[Column], Column] | None = None
    literal: str | None = None
    digit_edges: bool = False
    numeric: bool = False
    dotted: bool = False
    opening: str = ""


# Context words of the phone entities.
CALL_WORDS = ("phone", "tel", "contact", "call")
MOBILE_WORDS = ("mobile", *CALL_WORDS)
LANDLINE_WORDS = ("landline", *CALL_WORDS)

# Context phrases of the identity numbers. Context is compared with
# single words, so a phrase of several words never counts.
TFN_PHRASES = ("tfn", "tax file", "tax-file", "tax-file-number", "tax file number")
ABN_PHRASES = ("abn", "australian business number", "business number")
MEDICARE_PHRASES = ("medicare", "medicare no", "medicare number", "medicare card")
LICENCE_PHRASES = (
    "driver licence", "drivers licence", "driver's licence", "licence no", "licence number",
    "dl no", "nsw licence", "vic licence", "qld licence",
)

# Entity names, patterns and base scores, in registered order.
AU_RECOGNIZERS = (
    Recognizer("AU_MOBILE", ((r"\b04\d{2}[-\s]?\d{3}[-\s]?\d{3}\b", 0.85),),
               MOBILE_WORDS, literal="04", numeric=True),
    Recognizer("AU_MOBILE_INT", ((r"\+61\s?4\d{2}[-\s]?\d{3}[-\s]?\d{3}\b", 0.85),),
               MOBILE_WORDS, literal="+61", numeric=True),
    Recognizer("AU_LANDLINE", ((r"\b0[2378]\s?\d{4}\s?\d{4}\b", 0.8),),
               LANDLINE_WORDS, literal="0", numeric=True),
    Recognizer("AU_LANDLINE_INT", ((r"\+61\s?[2378]\s?\d{4}\s?\d{4}\b", 0.8),),
               LANDLINE_WORDS, literal="+61", numeric=True),
    Recognizer("AU_13", ((r"\b13\s?\d{2}\s?\d{2}\b", 0.75),),
               CALL_WORDS, literal="13", numeric=True),
    Recognizer("AU_1300", ((r"\b1300\s?\d{3}\s?\d{3}\b", 0.75),),
               CALL_WORDS, literal="1300", numeric=True),
    Recognizer("AU_1800", ((r"\b1800\s?\d{3}\s?\d{3}\b", 0.75),),
               CALL_WORDS, literal="1800", numeric=True),
    Recognizer("AU_TFN", ((r"\b\d{3}[-\s]?\d{3}[-\s]?\d{3}\b", 0.7),),
               TFN_PHRASES, checksums.valid_tfn, numeric=True),
    Recognizer("AU_ABN", ((r"\b\d{2}[-\s]?\d{3}[-\s]?\d{3}[-\s]?\d{3}\b", 0.7),),
               ABN_PHRASES, checksums.valid_abn, numeric=True),
    Recognizer("AU_MEDICARE", ((r"\b(?:\d{4}[-\s]?\d{5}[-\s]?\d|\d{10})\b", 0.85),),
               MEDICARE_PHRASES, checksums.valid_medicare, numeric=True),
    Recognizer("AU_DRIVER_LICENSE", ((r"\b\d{7,10}\b", 0.5),),
               LICENCE_PHRASES, numeric=True),
)
# Characters before the ``@``. A word boundary before them stands only where a run of them
# begins, behind its leading marks, or where the last match has ended in the middle of one. So
# each run is tried once and whole, and a long one without ``@`` costs no more than its length.
LOCAL = rf"[{DIGITS}{LETTERS}{WIDE}._%+-]"
EMAIL = Recognizer(
    "EMAIL_ADDRESS",
    ((rf"{LOCAL}++@[{DIGITS}{LETTERS}{WIDE}.-]+\.[{LETTERS}{WIDE}]{{2,}}\b", 1.0),),
    literal="@", opening=rf"\G(?<={WORD})|(?<!{LOCAL})[.%+-]*+(?={WORD})",
)
IP = Recognizer(
    "IP_ADDRESS", ((r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.6),),
    validator=checksums.valid_octets, literal=".", digit_edges=True, dotted=True,
)
PERSON = "PERSON"
PERSON_SCORE = 0.85

# No generic phone recognizer is registered: the Australian ones decide.
PATTERN_RECOGNIZERS = (*AU_RECOGNIZERS, EMAIL, IP)
ENTITY_ORDER = (*(r.entity for r in PATTERN_RECOGNIZERS), PERSON)


def registry(
    entities: Iterable[str] | None = None,
    extra: Iterable[Recognizer] = (),
    strict_medicare: bool = True,
) -> tuple[Recognizer, ...]:
    """Recognizers in registered order. Unwanted ones are not built at all."""
    chosen = [*PATTERN_RECOGNIZERS, *extra]
    if not strict_medicare:
        chosen = [
            r if r.entity != "AU_MEDICARE" else Recognizer(
                r.entity, r.patterns, r.context, numeric=r.numeric)
            for r in chosen
        ]
    if entities is not None:
        wanted = set(entities)
        chosen = [r for r in chosen if r.entity in wanted]
    return tuple(chosen)


def order_of(entity: str, recognizers: Iterable[Recognizer] = ()) -> int:
    """Place of an entity in registered order; plug-ins come after the built-in ones."""
    names = list(ENTITY_ORDER)
    names += [r.entity for r in recognizers if r.entity not in names]
    return names.index(entity)
