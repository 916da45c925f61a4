"""Patterns with Unicode word boundaries and spaces.

Java reads ``\\b`` and ``\\s`` as ASCII: an accented letter before a digit would count as
a boundary, and a no-break space as no space. Patterns are written as usual and widened
here before they reach Spark. ``\\d`` stays ASCII.
"""

from __future__ import annotations

# The characters Python's ``\s`` accepts, as a Java character class and listed.
SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
SPACES = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Letters and digits of ASCII, listed: Java looks listed characters up in a table, and tries
# ranges and properties one by one. Others, for use inside a class, with the quick test first.
DIGITS = "0123456789"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
WIDE = r"[[^\x00-\x7F]&&[\p{L}\p{N}]]"
WORD = rf"[{DIGITS}{LETTERS}_{WIDE}]"
BOUNDARY = rf"(?:(?={WORD})(?<!{WORD})|(?!{WORD})(?<={WORD}))"

# Beside a digit only one half of the boundary can hold; the digit is the quicker test.
BEFORE_DIGIT = rf"(?=[0-9])(?<!{WORD})"
AFTER_DIGIT = rf"(?!{WORD})"


def widen(pattern: str, digit_edges: bool = False) -> str:
    """A pattern with ``\\b``, ``\\s`` and ``\\w`` widened to Unicode.

    ``digit_edges``: boundaries at its ends are beside digits, so they are simpler.
    """
    if digit_edges:
        if pattern.startswith(r"\b"):
            pattern = BEFORE_DIGIT + pattern[2:]
        if pattern.endswith(r"\b"):
            pattern = pattern[:-2] + AFTER_DIGIT
    # Classes may be nested in Java, so this works inside brackets as well.
    return pattern.replace(r"\b", BOUNDARY).replace(r"\s", SPACE).replace(r"\w", WORD)
