"""Costly steps are taken once for each text, and no further than they must."""

import random
import re

import pytest
from pyspark.sql import functions as F

from catalog.queries import QUERIES
from mailveil.functions.folding import cut_out
from mailveil.functions.html import closable, html_to_text, unmarked
from mailveil.functions.patterns import widen
from mailveil.functions.recognizers import EMAIL, IP, LOCAL, registry
from mailveil.functions.spans import SEPARATOR, cut_at, detect, locate
from mailveil.functions.text import SPACE_LIKE, ZERO_WIDTH, csv_safe, strip_invisible
from mailveil.operators.people import CHAIN_START, WORD_START
from mailveil.plans.file_parts import last_words


def analyzed(rows):
    return rows._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("name", ["mask_text", "mask_message", "pii_count", "message_record"])
def test_texts_of_html_are_made_once(spark, small, name):
    # They are written once for the names and the findings; what follows reads no HTML.
    assert "html" not in analyzed(QUERIES[name](spark, small))


def test_last_words_split_only_the_end(spark):
    dice = random.Random(4)
    texts = ["".join(dice.choice(["ab", "C9", " ", "\n", "é", "-"]) for _ in range(dice.randrange(40)))
             for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = rows.select("text", last_words(F.col("text")).alias("words"))
    assert "split(regexp_extract(" in analyzed(rows)
    for row in rows.collect():
        words = re.findall("[A-Za-z0-9]+", row.text)
        assert row.words == [w[::-1] for w in words[::-1][:5]]


def test_capitals_come_before_looks_back():
    assert all(p.startswith(r"(?=\p{Lu})") for p in (WORD_START, CHAIN_START))


def test_csv_cleaning_takes_no_pattern(spark):
    texts = ['a"b\r\nc\rd\ne\n\r', "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select(csv_safe(F.col("v")).alias("s"))
    assert [r.s for r in rows.collect()] == ["a'b c d e  ", "", ""]
    assert "regexp" not in analyzed(rows) and "translate" not in analyzed(rows)


def test_invisible_characters_are_looked_for_without_a_pattern(spark):
    texts = ["plain", "é 中 𝒜", None, ""] + [f"a{c}b" for c in SPACE_LIKE + ZERO_WIDTH]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select(
        "v", strip_invisible(F.col("v")).alias("s"))
    assert "RLIKE" not in analyzed(rows)
    for row in rows.collect():
        assert row.s == (row.v and re.sub(f"[{ZERO_WIDTH}]", "", re.sub(f"[{SPACE_LIKE}]", " ", row.v)))


def test_html_is_not_reversed_for_its_last_tag(spark):
    texts = ["a<b>c<d", "<", "a>", "no tags", "", None, "x<!-- y", "<\x01p>\x07 > z<!--<q"]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select(
        "v", closable(unmarked(F.col("v"))).alias("s"))
    assert "reverse(" not in analyzed(rows)
    for row in rows.collect():
        head, close, tail = re.sub("[\x01-\x07]", "", row.v or "").rpartition(">")
        assert (row.s or "") == head + close + re.sub("<(?!!--)", "&lt;", tail)


def test_ip_addresses_are_searched_within_runs_of_digits(spark):
    assert IP.dotted
    dice = random.Random(5)
    parts = ["1.1.1.1", "10.1.2.3", "255.255.255.255", "999.1.1.1", "0412 345 678", "12", ".", "-",
             " ", "+", "é", "\u0663", "a", "_", "\n", "\U0001d49c", "51 824 753 556", "3.14159"]
    texts = ["".join(dice.choice(parts) for _ in range(dice.randrange(12))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.filter(locate(F.col("t"), widen(IP.patterns[0][0], True)),
                     lambda h: IP.validator(h["text"]))
    found = F.filter(detect(F.col("t"), registry()), lambda s: s["entity"] == IP.entity)

    def places(spans):
        return F.transform(spans, lambda s: F.struct(s["start"], s["end"]))

    rows = rows.select("t", places(whole).alias("whole"), places(found).alias("found")).collect()
    assert sum(len(r.whole) for r in rows) > 100
    assert all(r.whole == r.found for r in rows)


def test_characters_of_addresses_are_listed():
    assert not any("a-z" in p or "A-Z" in p for p in (LOCAL, EMAIL.patterns[0][0]))


def test_tags_are_written_in_one_pass(spark):
    """Names of tags in any case of ASCII; those that only look alike write nothing."""
    expected = {
        "a<LI>b</Li>c": "a\n* bc", "a<P/>b<br\t>c": "a\nb\nc", "a<li=1>b<lix>c": "abc",
        "a<bloc\u212aquote>b": "ab", "<td title='>'>a</TD>b</tH>c": "a b c",
        "x <PRE>a  b</pRe> c  d": "x\na  b\nc d", "<!-- <p> -->a<?p>b<script><p></script>c": "abc",
        "<head>t<p>u</HEAD>a<Head/>v<bODy >b": "a\nb", "<header>a</header>b<head>c": "a\nb",
        "1 <2 &lt;p> <p": "1 <2 <p> <p", "</p a=\"x>a<b>c\"": "</p a=\"x>ac\"",
    }
    rows = spark.createDataFrame([(t,) for t in expected], "t string")
    rows = rows.select("t", html_to_text(F.col("t")).alias("s"))
    assert analyzed(rows).count("regexp_replace(") < 12
    assert {r.t: r.s for r in rows.collect()} == expected


def test_separators_are_looked_for_before_they_are_replaced(spark):
    texts = ["a1b", "\x01a1\x01", "\x01", "", None, "é1"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = rows.select("t", cut_at(F.col("t"), "[0-9]", f"{SEPARATOR}$0{SEPARATOR}").alias("cut"))
    assert "CASE WHEN Contains(" in analyzed(rows)
    for row in rows.collect():
        assert row.cut == (None if row.t is None else re.split(
            "([0-9])", row.t.replace("\x01", "\x02")))


def test_empty_ranges_cut_out_nothing(spark):
    dice = random.Random(6)
    texts = ["".join(dice.choice("abcé中𝒜 ") for _ in range(60)) for _ in range(200)]
    cases = [(t, [(a, a + max(dice.randrange(-4, 9), 0)) for a in sorted(
        dice.randrange(60) for _ in range(dice.choice((0, 1, 2, 5, 140))))]) for t in texts]
    rows = spark.createDataFrame(cases, "t string, r array<struct<start:int,end:int>>")
    rows = rows.select("t", "r", cut_out(F.col("t"), F.col("r")).alias("cut"))
    # The stretch goes by ranges that hold something.
    assert "filter(" in analyzed(rows)
    for row in rows.collect():
        assert row.cut == [row.t[a:b] for a, b in row.r]
