"""Address lists and encoded words against the standard library."""

import base64
import quopri
import random
from email.header import decode_header
from email.utils import getaddresses

from pyspark.sql import functions as F

from mailveil.functions.addresses import split_list, split_plain, split_tokens, PLAIN_LIST
from catalog.queries import QUERIES
from mailveil.functions.encoded_words import decode_words


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in rows.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def pairs(found):
    return [(a.name, a.email) for a in found]


def standard(value):
    # A comment without a name before it stands behind a space there.
    return [(n.strip(), a) for n, a in getaddresses([value], strict=False) if (n, a) != ("", "")]


def corpus(seed, n):
    dice = random.Random(seed)
    words = ["Ann", "O'Neil", "J.", "van", "Ünsal", "x-y", "B2"]

    def comment(depth=0):
        inner = dice.choice(["home", "the \\) one", 'say "hi"', "a, b", "x@y"])
        return f"({inner}{comment(depth + 1) if depth < 3 and dice.random() < .3 else ''})"

    def quoted():
        return dice.choice(['"Last, First"', '"a \\"b\\" c"', '"semi; colon:"', '"back\\\\slash"',
                            '"(no comment)"', '"<no@angle>"'])

    def gap():
        return dice.choice(["", " ", " ", "  ", "\t", f" {comment()} "])

    def address():
        local = dice.choice(["ann", "a.b", "x+y", '"odd one"', '"q\\"t"', "müller"])
        return f"{local}@{dice.choice(['x.org', 'mail.example.com', '[10.0.0.1]'])}"

    def one():
        kind = dice.random()
        if kind < .3:
            return address() + dice.choice(["", f" {comment()}"])
        name = " ".join(dice.choice([quoted(), *dice.sample(words, 2)]) for _ in range(dice.randint(0, 3)))
        route = "@a.b:" if dice.random() < .05 else ""
        return f"{name}{gap()} <{route}{address()}>{dice.choice(['', ' ', f' {comment()}'])}"

    for _ in range(n):
        items = []
        for _ in range(dice.randint(0, 4)):
            if dice.random() < .15:
                members = ", ".join(one() for _ in range(dice.randint(0, 3)))
                items.append(f"{dice.choice(['Team', 'The group', quoted()])}: {members};")
            else:
                items.append(one())
        yield ", ".join(items)


def test_lists_equal_the_standard_parser(spark):
    values = list(corpus(1, 600))
    got = column(spark, values, split_list)
    wrong = [(v, pairs(g), standard(v)) for v, g in zip(values, got) if pairs(g) != standard(v)]
    assert wrong == []


def test_the_plain_way_gives_what_the_grammar_gives(spark):
    dice = random.Random(3)
    values = []
    for _ in range(300):
        items = [dice.choice(["a@b.c", ' "L, F" <x@y>', "Ann  Bee <c@d> ", "J. Q. <>", "nobody", "",
                              "<only@angle>", '""<q@r>', "Ünsal\t<ü@z>"])
                 for _ in range(dice.randint(0, 5))]
        values.append(",".join(items))
    plain = spark.createDataFrame([(v,) for v in values], "v string").filter(
        F.rlike("v", F.lit(PLAIN_LIST))).select(
        "v", split_plain(F.col("v")).alias("p"), split_tokens(F.col("v")).alias("t")).collect()
    assert len(plain) == len(values)
    assert [r.v for r in plain if pairs(r.p) != pairs(r.t)] == []


def test_odd_lists(spark):
    values = [None, "", " , ;", "(((", '"open', "[open", "<open@angle", "a@b)", "x@y <z@w>",
              "(c" * 500 + ")" * 500 + " a@b", "\\", "a@b,," * 2000 + "c@d", '"' * 999]
    got = column(spark, values, split_list)
    assert got[0] == got[1] == []
    assert pairs(got[6])[0][1] == "open@angle" and len(got[11]) == 2001
    assert pairs(got[9]) == [("c" * 500, "a@b")]


def word(text, charset="utf-8", kind="B"):
    raw = text.encode(charset)
    body = base64.b64encode(raw).decode() if kind == "B" else (
        "".join(f"={b:02X}" if not chr(b).isalnum() or b > 127 else chr(b) for b in raw))
    return f"=?{charset}?{kind}?{body}?="


def decoded(value):
    return "".join(part if isinstance(part, str) else part.decode(charset or "ascii")
                   for part, charset in decode_header(value))


def test_words_equal_the_standard_decoder(spark):
    dice = random.Random(5)
    texts = {"utf-8": "Grüße 日本 🙂 x_y=?", "iso-8859-1": "Größe £5", "windows-1252": "“€” – ok",
             "koi8-r": "Привет мир", "iso-8859-15": "œuvre €", "us-ascii": "plain",
             "iso-2022-jp": "日本語", "gb2312": "中文", "windows-1251": "Москва"}
    values = []
    for _ in range(300):
        parts = []
        for _ in range(dice.randint(1, 4)):
            charset = dice.choice(list(texts))
            parts.append(word(texts[charset], charset, dice.choice("BQ")))
        values.append(dice.choice(["", "Re: "]) + " ".join(parts) + dice.choice(["", " end"]))
    got = column(spark, values, decode_words)
    wrong = [(v, g) for v, g in zip(values, got) if g != decoded(v)]
    assert wrong == []


def test_neighbours_are_joined_before_decoding(spark):
    raw = "日本語のテキスト".encode()
    cut = [f"=?UTF-8?B?{base64.b64encode(raw[i:i + 5]).decode()}?=" for i in range(0, len(raw), 5)]
    mixed = [f"=?utf-8?Q?{quopri.encodestring(b'a_' + raw[:2]).decode().strip()}?=",
             f"=?utf-8?b?{base64.b64encode(raw[2:]).decode().rstrip('=')}?="]
    got = column(spark, ["\r\n ".join(cut), " ".join(cut) + " x", " ".join(mixed)], decode_words)
    assert got == [raw.decode(), raw.decode() + " x", "a " + raw.decode()]


def test_broken_words_stay(spark):
    values = ["=?utf-8?B?!!!?=", "=?nope?Q?abc?=", "=?utf-8?Q?=4?=", "=?utf-8?X?abc?=", "=?utf-8?Q?a",
              "a =?utf-8?B?!?= =?utf-8?Q?b?= c", "=? ?=", None, "", "=?utf-8?Q??=", "=?utf-8?Q?=FF?=",
              "=?utf-8*en?Q?ok?=", "=?us-ascii?Q?=E9?="]
    got = column(spark, values, decode_words)
    assert got == [*values[:5], "a =?utf-8?B?!?= b c", "=? ?=", None, "", "", "�", "ok", "�"]


def test_many_words_in_time(spark):
    long = " ".join([word("ab"), "gap"] * 4000)
    near = "\r\n ".join([word("é" * 20)] * 20_000)
    assert column(spark, [long, near], decode_words) == [
        " ".join(["ab", "gap"] * 4000), "é" * 400_000]


def test_encoded_texts_are_built_and_dealt_once(spark, small):
    rows = QUERIES["encoded_words"](spark, small)
    # Once for each form of the header, not for each piece or use; and no fold word by word.
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("encode(text") == 2 and "aggregate(" not in plan
    assert rows.rdd.getNumPartitions() >= 32
