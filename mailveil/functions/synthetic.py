"""Reproducible synthetic values.

Every draw is the first eight hex digits of ``md5(seed|message|field|entity|i)`` as a
number. It depends on nothing but its key, so retries and partitioning cannot change it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailveil.functions.binding import let
from mailveil.functions.checksums import (
    ABN_WEIGHTS, MEDICARE_WEIGHTS, TFN_WEIGHTS, weighted_sum,
)
from mailveil.functions.masking import PLACEHOLDERS

DEFAULT_SEED = 42

# Invented people for synthetic names and addresses.
FIRST_NAMES = (
    "Amelia", "Bruno", "Clara", "Dylan", "Elsie", "Felix", "Gemma", "Hamish",
    "Imogen", "Jasper", "Kirra", "Lachlan", "Matilda", "Noah", "Olive", "Patrick",
)
LAST_NAMES = (
    "Abbott", "Barlow", "Carver", "Drummond", "Ellery", "Forster", "Gibbs", "Hartley",
    "Irwin", "Jarvis", "Keating", "Lambert", "Murdoch", "Norris", "Osborne", "Pryor",
)
# Area codes of landlines.
AREA_CODES = ("02", "03", "07", "08")


class Draws:
    """The draws of one key prefix ``seed|message|field|entity``."""

    def __init__(self, prefix: Column):
        self.prefix = prefix

    def number(self, i: int | Column) -> Column:
        step = F.lit(str(i)) if isinstance(i, int) else i.cast("string")
        digest = F.md5(F.concat(self.prefix, F.lit("|"), step))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")

    def below(self, i: int | Column, n: int) -> Column:
        return self.number(i) % F.lit(n)

    def between(self, i: int, low: int, high: int) -> Column:
        return (F.lit(low) + self.below(i, high - low + 1)).cast("string")

    def digits(self, i: int | Column, width: int) -> Column:
        return F.lpad(self.below(i, 10**width).cast("string"), width, "0")

    def pick(self, i: int, choices: tuple[str, ...]) -> Column:
        options = F.array(*[F.lit(c) for c in choices])
        return F.get(options, self.below(i, len(choices)).cast("int"))


def key_prefix(seed: Column, message: Column, field: Column, entity: Column) -> Column:
    return F.concat_ws("|", seed.cast("string"), message.cast("string"), field, entity)


def grouped(digits: Column, sizes: tuple[int, ...], separator: str) -> Column:
    parts, at = [], 1
    for size in sizes:
        parts.append(F.substring(digits, at, size))
        at += size
    return F.concat_ws(separator, *parts)


def gen_tfn(draws: Draws) -> Column:
    """The ninth digit is the weighted sum mod 11. Ten is no digit; the eighth is then raised
    by one, nine to zero, which weighs 9 and makes it 8, or 6 after the wrap."""
    def whole(body: Column) -> Column:
        check, last = weighted_sum(body, TFN_WEIGHTS[:8]) % 11, F.right(body, F.lit(1))
        raised = F.concat(F.substring(body, 1, 7), ((last.cast("int") + 1) % 10).cast("string"))
        return F.when(check < 10, F.concat(body, check.cast("string"))).otherwise(
            F.concat(raised, F.when(last == "9", F.lit("6")).otherwise(F.lit("8"))))

    return grouped(let(draws.digits(0, 8), whole), (3, 3, 3), "-")


def gen_abn(draws: Draws) -> Column:
    """Nine digits are drawn; the first two follow, as they weigh 10 and 1 mod 89."""
    return let(draws.digits(0, 9), lambda tail: let(
        (F.lit(89) - weighted_sum(tail, ABN_WEIGHTS[2:]) % 89) % 89,
        lambda rest: grouped(F.concat(
            (F.floor(rest / 10) + 1).cast("string"), (rest % 10).cast("string"), tail),
            (2, 3, 3, 3), " ")))


def gen_medicare(draws: Draws) -> Column:
    return let(draws.digits(0, 8), lambda body: F.concat(
        F.substring(body, 1, 4), F.lit(" "), F.substring(body, 5, 4),
        draws.between(1, 1, 9), F.lit(" "),
        (weighted_sum(body, MEDICARE_WEIGHTS) % 10).cast("string")))


def gen_licence(draws: Draws) -> Column:
    # Two draws: the range is wider than one.
    wide = (draws.number(0) % F.lit(65536)) * F.lit(4294967296) + draws.number(1)
    return (F.lit(1_000_000) + wide % F.lit(9_999_000_000)).cast("string")


def gen_mobile(draws: Draws) -> Column:
    return F.concat(F.lit("04"), draws.digits(0, 2), F.lit(" "), draws.digits(1, 3),
                    F.lit(" "), draws.digits(2, 3))


def gen_mobile_int(draws: Draws) -> Column:
    return F.concat(F.lit("+61 4"), draws.digits(0, 2), F.lit(" "), draws.digits(1, 3),
                    F.lit(" "), draws.digits(2, 3))


def gen_landline(draws: Draws) -> Column:
    return F.concat_ws(" ", draws.pick(0, AREA_CODES), draws.between(1, 1000, 9999),
                       draws.between(2, 1000, 9999))


def gen_landline_int(draws: Draws) -> Column:
    area = F.substring(draws.pick(0, AREA_CODES), 2, 1)
    return F.concat_ws(" ", F.lit("+61"), area, draws.between(1, 1000, 9999),
                       draws.between(2, 1000, 9999))


def gen_13(draws: Draws) -> Column:
    return F.concat_ws(" ", F.lit("13"), draws.between(0, 10, 99), draws.between(1, 10, 99))


def gen_1300(draws: Draws) -> Column:
    return F.concat_ws(" ", F.lit("1300"), draws.between(0, 100, 999), draws.between(1, 100, 999))


def gen_1800(draws: Draws) -> Column:
    return F.concat_ws(" ", F.lit("1800"), draws.between(0, 100, 999), draws.between(1, 100, 999))


def gen_person(draws: Draws) -> Column:
    return F.concat_ws(" ", draws.pick(0, FIRST_NAMES), draws.pick(1, LAST_NAMES))


def gen_email(draws: Draws) -> Column:
    letters = F.lower(F.concat(draws.pick(0, FIRST_NAMES), draws.pick(1, LAST_NAMES)))
    return F.concat(letters, F.lit("."), draws.between(2, 100, 999), F.lit("@example.com"))


def gen_ip(draws: Draws) -> Column:
    return F.concat_ws(".", F.lit("10"), *[draws.between(i, 0, 255) for i in range(3)])


# In the order in which placeholders are replaced.
GENERATORS = {
    "PERSON": gen_person,
    "EMAIL_ADDRESS": gen_email,
    "IP_ADDRESS": gen_ip,
    "AU_MOBILE": gen_mobile,
    "AU_MOBILE_INT": gen_mobile_int,
    "AU_LANDLINE": gen_landline,
    "AU_LANDLINE_INT": gen_landline_int,
    "AU_13": gen_13,
    "AU_1300": gen_1300,
    "AU_1800": gen_1800,
    "AU_TFN": gen_tfn,
    "AU_ABN": gen_abn,
    "AU_MEDICARE": gen_medicare,
    "AU_DRIVER_LICENSE": gen_licence,
}


def generate(entity: str, message: Column, field: Column, seed: int | Column = DEFAULT_SEED) -> Column:
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return GENERATORS[entity](Draws(key_prefix(seed, message, field, F.lit(entity))))


def fill_placeholders(masked: Column, message: Column, field: Column,
                      seed: int | Column = DEFAULT_SEED) -> Column:
    """One value per placeholder type and text; only types that occur are drawn."""

    def fill(text: Column, entity: Column) -> Column:
        value = F.when(F.lit(False), F.lit(""))
        token = F.when(F.lit(False), F.lit(""))
        for name in GENERATORS:
            value = value.when(entity == name, generate(name, message, field, seed))
            token = token.when(entity == name, F.lit(PLACEHOLDERS[name]))
        return F.replace(text, token, value)

    present = F.filter(
        F.array(*[F.when(F.contains(masked, F.lit(PLACEHOLDERS[name])), F.lit(name))
                  for name in GENERATORS]),
        lambda e: e.isNotNull())
    return F.when(F.contains(masked, F.lit("<<")), F.aggregate(present, masked, fill)).otherwise(masked)
