"""What the language dictionaries are cut from."""

import random

from pyspark.sql import functions as F

from mailveil.llm import language_id as lid


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_texts_without_a_letter_are_unknown(docs_of):
    learned = lid.build_dictionaries({"en": [b"some words of english"] * 5, "de": [b"ein paar worte"] * 5})
    rows = [(1, "²"), (2, "½ ①"), (3, "Ⅷ"), (4, "٣ 12_3"), (5, "a²"), (6, "́")]
    out = {r.doc_id: (r.lang_pred, r.score) for r in lid.identify(
        docs_of(rows), learned, ["doc_id"]).collect()}
    assert {i for i, found in out.items() if found == (lid.UNKNOWN, 0.0)} == {1, 2, 3, 4, 6}


def test_many_rows_of_one_id_give_one_stretch(spark):
    rows = [(1, f"many words here {chr(97 + k % 26)}", "en") for k in range(600)]
    rows += [(2, "andere worte dort", "de"), (None, "nobody knows me", "en"), (3, None, "en")]
    learned = dict(lid.sample_dictionaries(labelled(spark, rows)))
    assert learned == {"en": b"many words here a", "de": b"andere worte dort"}


def test_stretches_come_from_anywhere(spark):
    """Documents that open alike teach what follows."""
    dice = random.Random(2)
    opening = "the same opening of every text " * 100
    rows = [(i, opening + " ".join(dice.choices(["uno", "dos", "tres"], k=3000)), "es")
            for i in range(40)]
    learned = dict(lid.sample_dictionaries(labelled(spark, rows)))["es"]
    assert learned.count(b"tres") > 500 and len(learned) <= lid.DICTIONARY_BYTES


def test_parts_are_equal_and_what_is_left_is_used():
    texts = [b"a" * 10, b"b" * 1000, b"c" * 1000]
    parts = sorted(map(len, lid.shared_out(texts, 513)))
    assert parts == [10, 250, 250]
    assert sorted(map(len, lid.shared_out(texts, 1 << 20))) == [10, 1000, 1000]
    assert lid.shared_out([], 10) == []


def test_rare_languages_teach_nothing(spark, monkeypatch):
    monkeypatch.setattr(lid, "LANGUAGES", 2)
    rows = [(i, "words", lang) for i, lang in enumerate(["c", "c", "c", "b", "b", "a", "a", "d"])]
    assert [name for name, _ in lid.sample_dictionaries(labelled(spark, rows))] == ["c", "a"]


def test_a_null_id_has_a_fold(spark):
    rows = spark.createDataFrame([(None,), (1,)], "doc_id long").select(lid.fold(5).alias("f"))
    assert [r.f for r in rows.collect()].count(None) == 0
