"""Character references: ``&eacute;``, ``&#233;`` and ``&#xE9;`` as characters.

The names are those of the HTML standard, taken from the standard library. A name without
its semicolon counts where the standard lets it, and then the longest such name.
"""

from __future__ import annotations

from functools import lru_cache
from html import unescape
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailveil.functions.binding import let
from mailveil.functions.spans import SEPARATOR, cut_at

NUMERIC = r"#[0-9]++;?|#[xX][0-9A-Fa-f]++;?"
# What most references are; looked at before the table of all.
USUAL = ("&amp;", "&nbsp;", "&lt;", "&gt;", "&quot;")
REPLACEMENT = "�"
LAST_CODE_POINT = 0x10FFFF


def tree(names: list[str]) -> str:
    """A pattern that finds the longest of the names, a character at a time."""
    branches: dict[str, list[str]] = {}
    for name in names:
        if name:
            branches.setdefault(name[0], []).append(name[1:])
    inner = "|".join(first + tree(rests) for first, rests in sorted(branches.items()))
    if not inner:
        return ""
    return f"(?:{inner})?+" if "" in names else f"(?:{inner})"


@lru_cache(None)
def reference_pattern() -> str:
    return f"&(?:{NUMERIC}|{tree(list(html5))})"


@lru_cache(None)
def _named_table() -> str:
    return "\x02".join(f"{name}\x03{text}" for name, text in sorted(html5.items()))


def named(reference: Column) -> Column:
    """The characters of a named reference."""
    # Folded to one map when the query is planned.
    table = F.call_function("str_to_map", F.lit(_named_table()), F.lit("\x02"), F.lit("\x03"))
    found = F.try_element_at(table, F.substr(reference, F.lit(2)))
    for name in reversed(USUAL):
        found = F.when(reference == name, unescape(name)).otherwise(found)
    return found


def code_point(number: Column) -> Column:
    """The character of a code point, by the rules for references in documents.

    Numbers of the C1 controls mean characters of Windows-1252; those of no character give
    the replacement character, and those of controls and noncharacters nothing.
    """
    c1 = F.array(*[F.lit(unescape(f"&#{n};")) for n in range(0x80, 0xA0)])
    written = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")

    def outside(low: int, high: int) -> Column:
        return number.between(low, high)

    unset = (outside(1, 8) | (number == 0xB) | outside(0xE, 0x1F) | (number == 0x7F)
             | outside(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE))
    return (
        F.when((number == 0) | outside(0xD800, 0xDFFF) | (number > LAST_CODE_POINT), REPLACEMENT)
        .when(outside(0x80, 0x9F), F.get(c1, (number - 0x80).cast("int")))
        .when(unset, "").otherwise(written)
    )


def numeric(reference: Column) -> Column:
    """The character of ``&#n;`` or ``&#xn;``."""
    hexadecimal = F.lower(F.substr(reference, F.lit(3), F.lit(1))) == "x"
    # Without leading zeros a number of seven decimal or six hexadecimal digits may be one.
    digits = F.regexp_extract(reference, r"^&#[xX]?0*+([0-9A-Fa-f]*+)", 1)
    number = F.when(F.length(digits) > 7, F.lit(LAST_CODE_POINT + 1)).otherwise(
        F.coalesce(F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).try_cast("long"),
                   F.lit(0)))
    return let(number, code_point)


def decode_references(text: Column) -> Column:
    """The text with its character references as characters; nothing is decoded twice.

    References of which the standard knows nothing stay as they are.
    """
    def decoded(piece: Column, i: Column) -> Column:
        # Gaps and references in turn, a gap first.
        return F.when(i % 2 == 0, piece).when(
            F.startswith(piece, F.lit("&#")), numeric(piece)).otherwise(named(piece))

    pieces = cut_at(text, reference_pattern(), f"{SEPARATOR}$0{SEPARATOR}")
    return F.when(F.contains(text, F.lit("&")), F.array_join(
        F.transform(pieces, decoded), "")).otherwise(text)
