"""Collocations against plain counting, the trie by itself, odd tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from mailveil.llm import collocations as col

DDL = "doc_id long, text string, lang string, rank string, n int"


def plain(rows, least, best, share):
    """``{(lang, rank): (phrase, a, l, r, n, score)}`` by counting every phrase."""
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = {}
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in candidates.items():
            if any(100 * b >= share * a and len(q) > len(p) and
                   any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, b in candidates.items()):
                continue
            score, _, left, right = min(
                (2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]])
                for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:best], 1):
            out[lang, rank] = (phrase.decode(), -a, left, right, totals[lang], -score)
    return out


def found(spark, rows, least=5, best=40, share=80):
    df = spark.createDataFrame([(i, t, g, "x", 1) for i, (t, g) in enumerate(rows)], DDL)
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score)
            for r in col.collocations(df.repartition(4), least, best, share).collect()}


def noise(seed, docs=120):
    dice = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["New", "york", "Été", " x", "a\x00b", "日本"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".\n", "! "]
    for _ in range(docs):
        text = ""
        while dice.random() > 0.02:
            text += ("new York city hall" if dice.random() < 0.1 else
                     dice.choices(words, weights=range(len(words), 0, -1))[0]) + dice.choice(ends)
        yield text, dice.choice(["en", "en", "fr", None])


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_counting(spark, seed):
    rows = list(noise(seed))
    want = plain(rows, 5, 40, 80)
    assert len(want) > 60 and found(spark, rows) == want


def test_small_limits_change_nothing(monkeypatch):
    """Bursts, spills and forgotten words; tasks run elsewhere, so they are tried on their own."""
    rows = list(noise(3, 60))
    monkeypatch.setattr(col, "WORDS", 30)
    everything = np.full(1 << (col.TABLE_BITS - 6), 0xFFFFFFFFFFFFFFFF, np.uint64)
    runs, resets = Counter(), 0

    def make():
        counter = col.LongCounter(col.Lexicon(everything), everything)
        counter.tries = {kind: col.BurstTrie(burst=10, held=50) for kind in counter.tries}
        return counter

    def take(batches):
        for batch in batches:
            for lang, phrase, f in zip(*(c.to_pylist() for c in batch.columns)):
                runs[lang, phrase] += f

    counter = make()
    for text, lang in rows:
        counter.count(counter.lexicon.numbers(lang or "und", [text.encode()]))
        take(counter.runs(col.BurstTrie.overflow))
        if counter.crowded():
            take(counter.runs(col.BurstTrie.spill))
            counter, resets = make(), resets + 1
    take(counter.runs(col.BurstTrie.spill))
    want = Counter()
    for text, lang in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (2, 3, 4):
                want.update((lang or "und", " ".join(words[i:i + k]))
                            for i in range(len(words) - k + 1))
    assert resets > 3 and runs == want


def test_trie_counts_and_keeps_order():
    dice = np.random.default_rng(1)
    trie, want = col.BurstTrie(burst=100, held=1000), Counter()
    out = Counter()
    for _ in range(40):
        first = dice.zipf(1.3, 500).astype(np.uint64) % np.uint64(50)
        keys, counts = np.unique(first << np.uint64(32) | dice.integers(0, 300, 500).astype(
            np.uint64), return_counts=True)
        trie.add(keys, counts)
        want.update(dict(zip(keys.tolist(), counts.tolist())))
        for run, n in trie.overflow():
            assert (np.diff(run.astype(object)) > 0).all()
            out.update(dict(zip(run.tolist(), n.tolist())))
        lows = [c.low for c in trie.containers]
        assert lows == sorted(lows) and len(trie) <= 1000
        assert all(c.n <= 100 for c in trie.containers)
    for run, n in trie.spill():
        out.update(dict(zip(run.tolist(), n.tolist())))
    assert out == want and len(trie) == 0


def test_exact_arithmetic(spark):
    """Products beyond 64 bits, and the first of equal cuts."""
    big = 10 ** 13
    counts = spark.createDataFrame(
        [("en", "a", 3 * big), ("en", "b", 2 * big), ("en", "a b", big + 1),
         ("en", "b a", big), ("en", "b a b", big), ("en", "a b a", 7)],
        "lang string, phrase string, f long")
    rows = {r.phrase: (r.a, r.l, r.r, r.score) for r in col.scored(counts.filter("f > 7")).collect()}
    assert rows["a b"] == (big + 1, 3 * big, 2 * big, 2_000_000 * (big + 1) // (5 * big))
    cuts = [(2_000_000 * big // (2 * big + big + 1), 1), (2_000_000 * big // (big + 2 * big), 2)]
    assert min(cuts)[1] == 1 and rows["b a b"] == (big, 2 * big, big + 1, min(cuts)[0])


def test_odd_rows(spark, docs_of, odd_rows):
    out = col.collocations(docs_of(odd_rows), least=2).collect()
    want = plain([(t, "en") for _, t in odd_rows], 2, 2000, 80)
    assert {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out} == want
    assert col.collocations(docs_of([])).count() == 0
