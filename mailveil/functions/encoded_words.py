"""Encoded words in headers: ``=?charset?B?...?=`` and ``=?charset?Q?...?=`` as text."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from mailveil.functions.binding import let
from mailveil.functions.spans import SEPARATOR, cut_at

# Characters are listed: Java looks listed ones up in a table, and tries ranges one by one.
DENSE = r"[^? \t\n\x0B\f\r]"
ENCODED_WORD = rf"=\?({DENSE}++)\?([bBqQ])\?({DENSE}*+)\?="
# Bytes of the Q encoding that are written as digits, as far as they go.
DIGIT = "[0123456789ABCDEFabcdef]"
ESCAPES = rf"(?:={DIGIT}{DIGIT})++"

# Names of character sets. Each byte of the first is a character; the others
# are read only where the session may use them (``wide_charsets``).
BYTE_CHARSETS = (
    "us-ascii", "iso-8859-1", "iso-8859-2", "iso-8859-3", "iso-8859-4", "iso-8859-5",
    "iso-8859-6", "iso-8859-7", "iso-8859-8", "iso-8859-9", "iso-8859-10", "iso-8859-13",
    "iso-8859-14", "iso-8859-15", "iso-8859-16", "windows-1250", "windows-1251", "windows-1252",
    "windows-1253", "windows-1254", "windows-1255", "windows-1256", "windows-1257",
    "windows-1258", "koi8-r", "koi8-u",
)
WIDE_CHARSETS = ("gb2312", "gbk", "gb18030", "big5", "shift_jis", "euc-jp", "iso-2022-jp", "euc-kr")
UTF8 = ("utf-8", "utf8")
HIGH_BYTES = "".join(map(chr, range(0x80, 0x100)))


def wide_charsets() -> tuple[str, ...]:
    """Character sets of several bytes that this session decodes without failing on bad ones."""
    conf = SparkSession.active().conf
    settings = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    on = all(str(conf.get(name, "false")).lower() == "true" for name in settings)
    return WIDE_CHARSETS if on else ()


@lru_cache(None)
def _upper_halves() -> str:
    """What the bytes from 0x80 mean in each charset of single bytes, by the codecs of the
    standard library."""
    return "\x02".join(f"{name}\x03" + bytes(range(0x80, 0x100)).decode(name, "replace")
                       for name in BYTE_CHARSETS)


def decode_charset(raw: Column, charset: Column) -> Column:
    """Bytes as text; bytes without a meaning become U+FFFD. The charset must be known."""
    # One map, folded when the query is planned: a case per charset would make large plans.
    halves = F.call_function("str_to_map", F.lit(_upper_halves()), F.lit("\x02"), F.lit("\x03"))
    by_byte = F.call_function("translate", F.decode(raw, "ISO-8859-1"), F.lit(HIGH_BYTES),
                              F.try_element_at(halves, charset))
    text = F.when(charset.isin(*UTF8), F.make_valid_utf8(raw.cast("string")))
    if wide_charsets():
        text = text.when(charset.isin(*wide_charsets()), F.call_function("decode", raw, charset))
    return text.otherwise(by_byte)


def base64_digits(payload: Column) -> Column:
    """Bytes of base64 with or without its padding as hex digits, null if it is none."""
    def padded(bare: Column) -> Column:
        return F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), "=")

    return F.hex(F.try_to_binary(let(F.rtrim(payload, F.lit("=")), padded), F.lit("base64")))


def quoted_digits(payload: Column) -> Column:
    """Bytes of the Q encoding as hex digits, null if an equals sign is not followed by two."""
    def read(parts: Column) -> Column:
        # Other text and runs of escapes in turn.
        digits = F.transform(parts, lambda p, i: F.when(
            i % 2 == 1, F.replace(p, F.lit("="), F.lit(""))).otherwise(F.hex(p)))
        broken = F.exists(F.filter(parts, lambda p, i: i % 2 == 0), lambda p: F.contains(p, F.lit("=")))
        return F.when(~broken, F.array_join(digits, ""))

    return let(cut_at(F.replace(payload, F.lit("_"), F.lit(" ")), ESCAPES,
                      f"{SEPARATOR}$0{SEPARATOR}"), read)


def read_word(word: Column) -> Column:
    """``struct<text, charset, digits>``, the bytes as hex digits; a broken word, or one in a
    charset not known, has null digits."""
    def read(parts: Column) -> Column:
        payload = F.get(parts, F.lit(3))
        # A language may follow the charset.
        charset = F.lower(F.substring_index(F.get(parts, F.lit(1)), "*", 1))
        digits = F.when(F.lower(F.get(parts, F.lit(2))) == "b", base64_digits(payload)).otherwise(
            quoted_digits(payload))
        return let(charset, lambda c: F.struct(
            word.alias("text"), c.alias("charset"),
            F.when(c.isin(*UTF8, *BYTE_CHARSETS, *wide_charsets()), digits).alias("digits")))

    # No part of a word holds a question mark.
    return let(F.split(word, r"\?", -1), read)


def decode_words(text: Column) -> Column:
    """The text with its encoded words decoded; broken ones stay as they are.

    White space between two words goes. Bytes of neighbours in one charset are joined before
    they are decoded, so a character may begin in one word and end in the next.
    """
    def decoded(words: Column, gaps: Column) -> Column:
        def near(k: Column) -> Column:
            """Whether only white space parts a word from the one before, and both are whole."""
            return ((k > 0) & F.get(words, k - 1)["digits"].isNotNull()
                    & F.get(words, k)["digits"].isNotNull()
                    & F.rlike(F.get(gaps, k), F.lit(r"^[ \t\r\n]*+$")))

        def joined(k: Column) -> Column:
            return near(k) & (F.get(words, k - 1)["charset"] == F.get(words, k)["charset"])

        def run(starts: Column, start: Column, i: Column) -> Column:
            """The words from one start to the next, behind their gap."""
            first = F.get(words, start)
            end = F.coalesce(F.get(starts, i + 1), F.size(words))
            raw = F.unhex(F.array_join(F.transform(
                F.slice(words, start + 1, end - start), lambda w: w["digits"]), ""))
            return F.concat(
                F.when(near(start), F.lit("")).otherwise(F.get(gaps, start)),
                F.when(first["digits"].isNull(), first["text"]).otherwise(
                    F.coalesce(decode_charset(raw, first["charset"]), F.lit(""))))

        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda k: ~joined(k))
        return let(starts, lambda held: F.array_join(F.transform(
            held, lambda start, i: run(held, start, i)), ""))

    def of_pieces(pieces: Column) -> Column:
        # Gaps and words in turn, a gap first and last.
        split = F.struct(
            F.transform(F.filter(pieces, lambda p, i: i % 2 == 1), read_word).alias("words"),
            F.filter(pieces, lambda p, i: i % 2 == 0).alias("gaps"))
        last = F.element_at(pieces, -1)
        return F.when(F.size(pieces) == 1, last).otherwise(
            F.concat(let(split, lambda s: decoded(s["words"], s["gaps"])), last))

    pieces = cut_at(text, ENCODED_WORD, f"{SEPARATOR}$0{SEPARATOR}")
    return F.when(F.contains(text, F.lit("=?")), let(pieces, of_pieces)).otherwise(text)
