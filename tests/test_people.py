"""Names of one to four words against a plain search."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from mailveil.operators import people as P


def plain(text, names):
    """Leftmost, then longest chains of capitalised words that are names."""
    words = [(m.start(), m.end()) for m in re.finditer(r"(?<![^\W\d_])[^\W\d_a-zß-öø-ÿ][^\W\d_]*", text)
             if m[0][0].isupper()]
    out, reached = [], 0
    for i, (start, _) in enumerate(words):
        if start < reached:
            continue
        best = None
        for k in range(1, P.MOST_WORDS + 1):
            chain = words[i:i + k]
            if len(chain) < k or any(text[a[1]:b[0]] != " " for a, b in zip(chain, chain[1:])):
                break
            if text[start:chain[-1][1]].lower() in names:
                best = chain[-1][1]
        if best:
            out.append((start, best))
            reached = best
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_search(spark, seed):
    dice = random.Random(seed)
    vocabulary = ["Ann", "Bo", "Cruz", "Étoile", "D", "the", "von", "X9", "O'Neil"]
    names = {" ".join(dice.choices(["ann", "bo", "cruz", "étoile", "d"], k=dice.randint(1, 5)))
             for _ in range(25)}
    texts = ["".join(dice.choice(vocabulary) + dice.choice([" ", " ", " ", "  ", ", ", "\n", "-"])
                     for _ in range(dice.randint(0, 30))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "msg_seq long, text string").repartition(4)
    table = spark.createDataFrame([(n, 1) for n in names], "name string, n long")
    got = {r.msg_seq: [(p.start, p.end) for p in r.people]
           for r in P.person_spans(rows, table).collect()}
    want = {i: plain(t, names) for i, t in enumerate(texts)}
    assert got == {i: spans for i, spans in want.items() if spans}
    assert {len(n.split()) for n in names} == {1, 2, 3, 4, 5} and len(got) > 150


def test_never_a_shorter_name_inside_a_longer_one(spark):
    rows = spark.createDataFrame([(1, "Maria Ann Lee and Ann Lee met Lee")], "msg_seq long, text string")
    table = spark.createDataFrame([(n, 1) for n in ("lee", "ann lee", "maria ann lee", "lee and")],
                                  "name string, n long")
    people = P.person_spans(rows, table).first().people
    text = "Maria Ann Lee and Ann Lee met Lee"
    assert [text[p.start:p.end] for p in people] == ["Maria Ann Lee", "Ann Lee", "Lee"]


def test_no_names_and_long_texts(spark):
    rows = spark.createDataFrame([(1, "A" * 1_000_000), (2, "Ann Lee " * 50_000), (3, None), (4, "")],
                                 "msg_seq long, text string")
    none = spark.createDataFrame([], "name string, n long")
    assert P.person_spans(rows, none).count() == 0
    start = time.time()
    table = spark.createDataFrame([("ann lee", 1), ("lee", 1)], "name string, n long")
    out = P.person_spans(rows, table).select("msg_seq", F.size("people").alias("n")).collect()
    assert [(r.msg_seq, r.n) for r in out] == [(2, 50_000)] and time.time() - start < 60
