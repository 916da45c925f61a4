"""HTML, references, bytes and e-mail addresses: definitions, hard inputs, time."""

import random
import re
import time
from html import unescape
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from mailveil.functions.html import html_to_text
from mailveil.functions.patterns import widen
from mailveil.functions.recognizers import EMAIL, WIDE
from mailveil.functions.references import decode_references
from mailveil.functions.spans import detect, locate
from mailveil.functions.text import decode_bytes


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


PAGES = {
    "<p>a<b>b</b>c</p>": "abc",
    "<a title='x>y' rel=\"p>q\" z=5>t</a>": "t",
    "<p don't>ok</p> it's": "ok\nit's",
    "a<!-- b > <p> -- -->c<!-->d<!-- never closed <p>x": "acd",
    "<script>if(a<b){'</p>'}</script>z": "z",
    "<SCRIPT>x</script >y<script-x>z</script-x>": "yz",
    "x<style>p{}</styles>still</style>y": "xy",
    "x<script>never closed <p>y": "x",
    "<head><title>T</title></head>b<header>c</header>": "b\nc",
    "<head><title>T</title>no end<body>seen": "seen",
    " a \n\t b <b> c</b>  d ": "a b c d",
    "a<pre>x  y\n  z</pre>b   c": "a\nx  y\nz\nb c",
    "<pre>open  to\nthe end": "open  to\nthe end",
    "<ul><li>a<li class=x>b</ul>c": "* a\n* b\nc",
    "<table><tr><td>1</td><td>2</td></tr></table>": "1 2",
    "a<br/>b<br>c<hr />d": "a\nb\nc\nd",
    "1 < 2 and 3 > 2 and <c": "1 < 2 and 3 > 2 and <c",
    "5 <6 & </7 <": "5 <6 & </7 <",
    "&lt;b&gt; &amp;lt; a&nbsp;b&copy;c &#233;&#xe9; &NotEqualTilde; &ampx": "<b> &lt; a b©c éé ≂̸ &x",
    "<!DOCTYPE html><?xml x?>t": "t",
    "a\x01b\x07c": "abc",
    "": "",
    "plain": "plain",
}


def test_pages(spark):
    got = column(spark, [*PAGES, None], html_to_text)
    assert dict(zip(PAGES, got)) == PAGES and got[-1] is None


def test_references_equal_the_standard_library(spark):
    dice = random.Random(1)
    texts = [f"&{n}{tail}" for n in html5 for tail in ("", "x", ";")]
    texts += [f"&#{n};" for n in [*range(0, 400), 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0x1FFFF, 0x10FFFF,
                                  0x110000, 10 ** 7, 10 ** 30]]
    texts += [f"&#x{n:x}" for n in (0, 9, 0x80, 0x1F600, 0x110000, 16 ** 40)] + ["&#00000000065;"]
    texts += ["".join(dice.choice(["&", "#", "x", "amp", "lt", ";", "12", "a", "é", "not", "in", "0", " "])
                      for _ in range(30)) for _ in range(500)]
    got = column(spark, texts, decode_references)
    assert [(t, g) for t, g in zip(texts, got) if g != unescape(t)] == []


HARD = {
    "comments": "<!-- a " * 150_000, "scripts": "<script> " * 120_000, "styles": "<style>" * 150_000,
    "quoted": "<a x='" * 170_000, "attributes": "<a " + 'x="1" ' * 150_000 + ">t",
    "references": "&amp;x" * 170_000, "unknown": "&zzzz;" * 170_000, "pre": "<pre>a  b</pre> " * 60_000,
    "open quotes": '<p a="' * 150_000 + ">", "less": "<" * 1_000_000, "heads": "<head>" * 150_000,
}


@pytest.mark.parametrize("name", HARD)
def test_a_megabyte_in_seconds(spark, name):
    rows = spark.createDataFrame([(HARD[name],)], "v string")
    start = time.time()
    rows.select(F.length(html_to_text(F.col("v")))).collect()
    assert time.time() - start < 30


def test_bytes_equal_the_standard_decoder(spark):
    dice = random.Random(2)
    pool = [b"\xef\xbf\xbd", b"\xe2", b"\xf0\x9f", b"\x80", b"\xff", "é日🙂".encode(), b"\x1a0", b"\x1a1",
            b"\x1a", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80", b"a", b"\x00"]
    values = [b"".join(dice.choice(pool) for _ in range(dice.randint(0, 12))) for _ in range(600)]
    values += [bytes(dice.choices(range(256), k=40)) for _ in range(200)]
    got = column(spark, values, decode_bytes, "binary")
    assert [(v, g) for v, g in zip(values, got) if g != v.decode("utf-8", "ignore")] == []


# The e-mail pattern as it is usually written, quadratic on long runs without an @.
USUAL = rf"\b[A-Za-z0-9{WIDE}._%+-]+@[A-Za-z0-9{WIDE}.-]+\.[A-Za-z{WIDE}]{{2,}}\b"


def test_addresses_are_found_as_before(spark):
    dice = random.Random(4)
    pool = ["a", "b1", ".", "-", "+", "%", "_", "@", "@", "x.org", ".com", "é", " ", "日本", "co", "(", "²"]
    texts = ["".join(dice.choice(pool) for _ in range(dice.randint(1, 25))) for _ in range(3000)]
    texts += ["..a@b.co", "%-x@y.org+c@d.org", "a@b.com.c@d.com", "_@x.org", "a@b.c1", "é.a@ü.de "]
    old = column(spark, texts, lambda v: F.transform(
        locate(v, widen(USUAL)), lambda h: F.struct(h["start"], h["end"])))
    new = column(spark, texts, lambda v: F.transform(
        detect(v, [EMAIL]), lambda h: F.struct(h["start"], h["end"])))
    assert [(t, o, n) for t, o, n in zip(texts, old, new) if list(map(tuple, o)) != list(map(tuple, n))] == []
    assert sum(map(len, new)) > 200


@pytest.mark.parametrize("text", [
    "a.b-" * 250_000 + " x@y", "a.b-" * 250_000 + "@y", "x@" + "a.b-" * 250_000, "a@b " * 250_000,
    "%3D%3C" * 170_000 + "@", "me@x.org " * 20_000])
def test_a_megabyte_of_address_characters(spark, text):
    rows = spark.createDataFrame([(text,)], "v string")
    start = time.time()
    found = rows.select(F.size(detect(F.col("v"), [EMAIL]))).first()[0]
    assert time.time() - start < 30
    assert found == (20_000 if text.startswith("me@") else 0)
