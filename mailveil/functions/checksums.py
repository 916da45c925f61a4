"""Checksum rules of the Australian numbers, as integer arithmetic on digits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published digit weights.
TFN_WEIGHTS = (1, 4, 3, 7, 5, 8, 6, 9, 10)
ABN_WEIGHTS = (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)
MEDICARE_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def digit(digits: Column, position: int) -> Column:
    """Digit at a 1-based position."""
    return F.substring(digits, position, 1).cast("int")


def weighted_sum(digits: Column, weights: Sequence[int], first: int = 1) -> Column:
    terms = [digit(digits, first + i) * F.lit(w) for i, w in enumerate(weights)]
    return reduce(lambda a, b: a + b, terms)


def valid_tfn(text: Column) -> Column:
    d = digits_of(text)
    return F.when(F.length(d) == 9, weighted_sum(d, TFN_WEIGHTS) % 11 == 0).otherwise(F.lit(False))


def valid_abn(text: Column) -> Column:
    d = digits_of(text)
    # One is taken off the first digit, which carries the first weight.
    total = weighted_sum(d, ABN_WEIGHTS) - F.lit(ABN_WEIGHTS[0])
    return F.when(F.length(d) == 11, total % 89 == 0).otherwise(F.lit(False))


def valid_medicare(text: Column) -> Column:
    d = digits_of(text)
    check = weighted_sum(d, MEDICARE_WEIGHTS) % 10
    return F.when(
        F.length(d) == 10, (digit(d, 9) >= 1) & (check == digit(d, 10))
    ).otherwise(F.lit(False))


def valid_octets(text: Column) -> Column:
    return F.forall(F.split(text, r"\.", -1), lambda octet: octet.cast("int") <= 255)


def valid_luhn(text: Column) -> Column:
    """Luhn rule over 16 digits: every second digit from the left is doubled."""
    d = digits_of(text)
    doubled = [digit(d, p) * 2 for p in range(1, 17, 2)]
    folded = [F.when(x > 9, x - 9).otherwise(x) for x in doubled]
    plain = [digit(d, p) for p in range(2, 17, 2)]
    total = reduce(lambda a, b: a + b, folded + plain)
    return F.when(F.length(d) == 16, total % 10 == 0).otherwise(F.lit(False))
