"""Decoding, whitespace and preview of texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailveil.functions.binding import let
from mailveil.functions.patterns import SPACE, SPACES

# Characters shown as a space, and characters without any width.
SPACE_LIKE = "\u00a0\u202f\u2007\u2009"
ZERO_WIDTH = (
    "\u200b\u200c\u200d\ufeff\u2060\u034f\u180e\u00ad\u202a\u202b\u202c\u202d\u202e"
)


# Stands for a genuine replacement character while bad bytes become one.
ESCAPE, BAD = "\x1a", "\ufffd"


def decode_bytes(raw: Column) -> Column:
    """UTF-8 with bad bytes dropped.

    Genuine replacement characters stay: they are escaped before bad bytes turn into one. Three
    whole bytes are one wherever they stand, as no character goes on across their first.
    """
    def replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
        for old, new in pairs:
            text = F.replace(text, F.lit(old), F.lit(new))
        return text

    text = replaced(raw.cast("string"), ((ESCAPE, ESCAPE + "0"), (BAD, ESCAPE + "1")))
    return replaced(F.make_valid_utf8(text),
                    ((BAD, ""), (ESCAPE + "1", BAD), (ESCAPE + "0", ESCAPE)))


def decode_or_error(raw: Column) -> Column:
    """Strict UTF-8; a text that cannot be read becomes an error note and the row stays."""
    return F.when(raw.isNotNull(), F.coalesce(
        F.try_validate_utf8(raw.cast("string")),
        F.lit("[Error extracting body: invalid UTF-8]")))


def holds_any(text: Column, characters: str) -> Column:
    """Whether the text holds one of the characters. Looking for each in the bytes costs much
    less than a pattern, which tries all of them on every character."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in characters])


def strip_invisible(text: Column) -> Column:
    # translate() deletes the characters that have no partner.
    return let(text, lambda t: F.when(
        holds_any(t, SPACE_LIKE + ZERO_WIDTH),
        F.translate(t, SPACE_LIKE + ZERO_WIDTH, "    ")).otherwise(t))


def collapse_newlines(text: Column) -> Column:
    """At most one empty line in a row, no spaces at line ends, none around the text.

    A carriage return before a line break counts as a space at the line's end.
    """
    fewer = F.regexp_replace(text, rf"\n{SPACE}*\n{SPACE}*\n+", "\n\n")
    lines = F.transform(F.split(fewer, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)))
    return F.btrim(F.array_join(lines, "\n"), F.lit(SPACES))


def csv_safe(text: Column) -> Column:
    """No nulls, no double quotes, no line breaks."""
    safe = F.coalesce(text, F.lit(""))
    for old, new in (('"', "'"), ("\r\n", " "), ("\r", " "), ("\n", " ")):
        safe = F.replace(safe, F.lit(old), F.lit(new))
    return safe


def subject_preview(subject: Column, width: int = 50) -> Column:
    empty = subject.isNull() | (subject == "")
    return F.when(empty, F.lit("(no subject)")).otherwise(F.substring(subject, 1, width))


def body_preview(body: Column, width: int = 200) -> Column:
    return F.when(F.length(body) > width, F.concat(F.substring(body, 1, width), F.lit("..."))
                  ).otherwise(body)
