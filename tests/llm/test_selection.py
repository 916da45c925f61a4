"""Language, contamination, quality, language model and shards."""

import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailveil.llm import decontamination, lm_scoring, quality
from mailveil.llm.language_id import (
    UNKNOWN, Classifier, build_dictionaries, drop_unidentified, fold, identify,
    sample_dictionaries)
from mailveil.llm.sharding import assign_shards, number_slots, shard_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_fold_is_crc32(spark):
    rows = spark.range(200).withColumnRenamed("id", "doc_id").select("doc_id", fold(7).alias("f"))
    assert all(r.f == crc32(str(r.doc_id).encode()) % 7 for r in rows.collect())


def test_held_out_languages(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    learned = sample_dictionaries(docs.filter(fold(5) != 0))
    rows = identify(docs, learned, ["lang", (fold(5) == 0).alias("held_out")]).filter(
        "held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) < 0.02 * len(rows)


def test_languages_of_odd_rows(docs_of, odd_rows):
    learned = build_dictionaries({"en": [b"the words of some text "] * 9, "xx": [b"zq kv jx "] * 9})
    rows = identify(docs_of(odd_rows), learned, ["doc_id", "score"]).collect()
    assert len(rows) == len(odd_rows)
    by = {r.doc_id: r for r in rows}
    for i in (3, 4, 5, 11, 12):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == (UNKNOWN, 0.0, True)
    assert identify(docs_of(odd_rows), [], ["doc_id"]).filter("rejected").count() == len(odd_rows)
    assert drop_unidentified(docs_of([])).count() == 0


def test_mislabelled_texts_teach_nothing():
    rnd = random.Random(1)
    one = [" ".join(rnd.choices(["alpha", "beta", "gamma", "delta"], k=60)).encode() for _ in range(40)]
    two = [" ".join(rnd.choices(["uno", "dos", "tres", "cuatro"], k=60)).encode() for _ in range(40)]
    built = dict(build_dictionaries({"one": one, "two": two + one[:1]}))
    assert b"alpha" not in built["two"]
    name, score, margin = Classifier(list(built.items())).classify("Dos tres UNO cuatro dos")
    assert name == "two" and score > 0.5 and margin > 0


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_contamination(rows, items, size):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + size]), set()).add(str(item))
    for i, text in rows:
        w, hit, found = words_of(text), set(), set()
        for window, owners in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k:k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    found |= owners
        yield i, len(w), len(hit), sorted(found)


@pytest.mark.parametrize("pass_bytes", [16 << 20, 60])
def test_contamination(spark, docs_of, odd_rows, monkeypatch, pass_bytes):
    monkeypatch.setattr(decontamination, "PASS_BYTES", pass_bytes)
    rnd = random.Random(6)
    items = [(k, " ".join(rnd.choices("abcdefg", k=rnd.randint(1, 9)))) for k in range(12)]
    items += [(50, None), (51, ""), (52, "!!"), (53, "Alpha-Beta"), (3, items[3][1]),
              (54, "a b, A b a b"), (None, "a a a")]
    rows = [(k + 100, " ".join(rnd.choices("abcdefg", k=rnd.randint(0, 80)))) for k in range(60)]
    rows += [r for r in odd_rows if r[0] not in (7, 8)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_contamination(docs_of(rows), bench, 4).collect()
    got = [(r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), r["items"]) for r in found]
    usable = [i for i in items if i[0] is not None]
    assert sorted(got, key=repr) == sorted(brute_contamination(rows, usable, 4), key=repr)
    assert all(a.stop < b.start for r in found for a, b in zip(r.spans, r.spans[1:]))


def test_proximity(spark, docs_of):
    bench = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    docs = docs_of([(1, "blue x green y red"), (2, "red green"), (3, "blue " + "x " * 9 + "red green"),
                    (4, "red green blue")])
    rows = decontamination.find_contamination(docs, bench, 3, reach=4).collect()
    assert {r.doc_id: (r["items"], r.near_items) for r in rows} == {
        1: ([], ["1"]), 2: ([], []), 3: ([], []), 4: (["1"], ["1"])}


def test_contaminated_documents_go(spark, docs_of):
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    docs = docs_of([(1, "zero One, two THREE four five"), (2, "one two"), (3, None)])
    kept = decontamination.drop_contaminated(docs.withColumn("items", F.lit(5)), bench, 4)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert kept.columns == [*docs.columns, "items"]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.drop_contaminated(docs, none).count() == 3


def test_quality_of_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.train(docs, labels.filter("doc_id % 2 = 0"))
    rows = quality.score_quality(docs, model, F.col("source"), F.col("lang")).join(
        labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good = [r.keep for r in rows if r.quality == 1]
    bad = [r.keep for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_sparse_sites_are_shrunk(spark):
    rows = [(k, "big", "big/a", 0.9) for k in range(500)] + [(k, "bad", "bad/a", 0.1) for k in range(500)]
    rows += [(1000, "one", "one/x", 0.0)]
    judged = spark.createDataFrame(rows, "doc_id long, host string, path string, p double")
    rates = {r.host: r.host_rate for r in quality.site_rates(judged, 0.5).collect()}
    assert rates["big"] > 0.85 and rates["bad"] < 0.15 and 0.2 < rates["one"] < 0.5


def test_quality_of_odd_rows(spark, docs_of, odd_rows):
    labels = spark.createDataFrame([(1, 1), (12, 0), (None, 1), (2, None)], "doc_id long, quality int")
    model = quality.train(docs_of(odd_rows), labels)
    rows = quality.score_quality(docs_of(odd_rows), model, F.lit(None), F.col("lang")).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    untaught = quality.train(docs_of(odd_rows), labels.limit(0))
    assert quality.score_quality(docs_of([]), untaught, F.col("source"), F.col("lang")).count() == 0


def lm_tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [" "]


@pytest.mark.parametrize("head", [400_000, 3])
def test_base_scores(docs_of, odd_rows, monkeypatch, head):
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    monkeypatch.setattr(lm_scoring, "STEPS", 1)
    rows = [*odd_rows, (20, "alpha beta new words"), (21, "gamma " * 50)]
    learn = F.coalesce(F.col("doc_id") != 20, F.lit(True))
    got = lm_scoring.score_texts(docs_of(rows), learn).collect()
    counts = Counter(w for i, t in rows if i != 20 for w in lm_tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, text in rows:
        w = lm_tokens(text)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        want.append((i, len(w), sum(counts[x] > 0 for x in w), n, round(base, 4)))
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4))
                   for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.score < 0 for r in got)


def test_model_is_a_distribution_and_learns(spark, docs_of):
    docs = docs_of([(k, "the cat sat on the mat " * 5) for k in range(20)])
    counts = lm_scoring.count_tokens(docs)
    head = lm_scoring.head_words(counts)
    events = lm_scoring.count_events(docs, head)
    weights = lm_scoring.train(events, steps=30)
    history = np.arange(lm_scoring.CONTEXTS ** 2)
    logs = lm_scoring.class_logs(weights, history)
    assert np.allclose(np.exp(logs).sum(axis=1), 1)
    totals = lm_scoring.class_totals(counts, head)
    assert totals[0].sum() == 20 * 31 and totals[1].sum() == 6
    seen = events.collect()
    flat = np.log(1 / lm_scoring.CLASSES)
    assert sum(r.n * logs[r.history, r.kind] for r in seen) / sum(r.n for r in seen) > flat / 4


def test_model_beats_unigrams_on_held_out_text(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    out = lm_scoring.score_texts(docs, fold(7) != 2).filter(fold(7) == 2)
    base, score = out.agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base


def test_nothing_to_learn_from(docs_of, odd_rows):
    rows = lm_scoring.score_texts(docs_of(odd_rows), F.lit(False)).collect()
    assert len(rows) == len(odd_rows) and all(r.n_known == 0 == r.train_tokens for r in rows)
    assert lm_scoring.score_texts(docs_of([]), F.lit(True)).count() == 0


@pytest.mark.parametrize("head", [1000, 3])
def test_every_word_is_a_context(docs_of, monkeypatch, head):
    """Words of one ending, none of them frequent, each tell the next word and, behind a frequent
    one, the word after that."""
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    fill = "the " * 10 + " ".join(f"fill{i}" for i in range(45) for _ in range(5))
    taught = [fill, "oneword east", "twoword north", "oneword the east", "twoword the north"] * 20
    asked = ["oneword east", "oneword north", "twoword north", "twoword east",
             "oneword the east", "oneword the north", "twoword the north", "twoword the east"]
    rows = [*enumerate(taught), *enumerate(asked, 100)]
    got = {r.doc_id: r.score for r in
           lm_scoring.score_texts(docs_of(rows), F.col("doc_id") < 100).collect()}
    # Alone, ``east`` and ``north`` are alike.
    for i in range(100, 108, 2):
        assert got[i] > got[i + 1] + 0.2


def test_words_in_and_outside_the_head_are_scored_alike(docs_of, monkeypatch):
    dice = random.Random(5)
    weights = [1 / (i + 1) for i in range(600)]
    words = [f"w{i}" + "x" * (40 if i % 50 == 7 else 0) for i in range(600)]
    texts = [" ".join(dice.choices(words, weights, k=dice.randrange(60))) for _ in range(150)]
    texts += [texts[0], "", None, words[599], "never seen w1 never"]
    docs, found = docs_of(list(enumerate(texts))), []
    for head in (5000, 150):
        monkeypatch.setattr(lm_scoring, "HEAD", head)
        rows = lm_scoring.score_texts(docs, F.col("doc_id") % 7 != 2).orderBy("doc_id").collect()
        found.append(np.array([[r.n_tokens, r.n_known, r.base_score, r.score] for r in rows]))
    assert np.allclose(*found, rtol=1e-3)
    assert len(found[0]) == len(texts)


def test_weights_of_keys():
    """Probabilities sum to one beside every side, and seen classes are expected as often as they
    were seen, with the prior's share."""
    dice = np.random.default_rng(3)
    base = dice.dirichlet(np.ones(6), 4).astype(np.float32)
    joint = dice.poisson(dice.choice([0, 0.3, 5], (50, 1, 1)) * dice.random((50, 4, 6)))
    seen, sides = joint.sum(axis=1).astype(np.float32), joint.sum(axis=2).astype(np.float32)
    weights, rooms = lm_scoring.fit(seen, sides, base)
    probs = base * np.exp(weights.astype(np.float64)[:, None] - rooms[:, :, None])
    assert np.allclose(probs.sum(axis=2), 1, atol=1e-5)
    prior = lm_scoring.PRIOR * sides / np.maximum(sides.sum(axis=1, keepdims=True), 1)
    expected = np.einsum("ws,wsk->wk", sides + prior, probs)
    wanted = seen + prior @ base
    assert np.allclose(expected[seen > 0], wanted[seen > 0], rtol=0.03)
    assert not weights[seen == 0].any()


def test_long_frequent_words_are_in_the_head(docs_of):
    word = "z" * 100
    counts = lm_scoring.count_tokens(docs_of([(1, f"{word} a {word}"), (2, word)]))
    head = lm_scoring.head_words(counts)
    place, kind, _ = head.look_up([word.encode(), b"a", b"b"])
    assert place.tolist() == [1, 2, -1] and head.count[1] == 3 and kind[0] == 1


def test_shards(docs_of, odd_rows):
    rows = shard_documents(docs_of(odd_rows), 5).collect()
    assert len(rows) == len(odd_rows)
    by_shard = {}
    for r in rows:
        text = dict(odd_rows)[r.doc_id] or ""
        assert r.size == len(text.encode()) + 8 and r.text_crc32 == crc32(text.encode())
        assert r.grown_shard in (r.shard, 5)
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_weights_and_growth(spark):
    rows = spark.range(6000).withColumnRenamed("id", "doc_id")
    out = assign_shards(rows, F.col("doc_id"), [1, 2, 3], [1, 2, 3, 6]).collect()
    sizes = Counter(r.shard for r in out)
    assert abs(sizes[2] / sizes[0] - 3) < 0.4 and abs(sizes[1] / sizes[0] - 2) < 0.3
    moved = [r for r in out if r.shard != r.grown_shard]
    assert all(r.grown_shard == 3 for r in moved) and abs(len(moved) / 6000 - 0.5) < 0.03
    with pytest.raises(ValueError):
        assign_shards(rows, F.col("doc_id"), [1, 2], [2, 1, 1])


def test_slots_of_repeated_keys(spark):
    rows = spark.createDataFrame([(7, 0)] * 30 + [(None, 0)] * 5, "doc_id long, shard int")
    slots = number_slots(rows, "shard", F.col("doc_id"), ["doc_id"]).collect()
    assert sorted(r.slot for r in slots) == list(range(35))
