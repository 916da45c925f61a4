"""Exact, near and substring duplicates against brute force."""

import random
import re
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
import xxhash

from mailveil.llm import simhash
from mailveil.llm.components import connected_components
from mailveil.llm.exact_dedup import drop_exact_copies, exact_groups, merge_runs
from mailveil.llm.suffix_dedup import remove_repeats


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_groups(docs_of, odd_rows, keep):
    rows = [r for r in odd_rows if r[0] is not None]
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    best = max if keep == "max" else min
    want = [(i, best(groups[t or ""]), len(groups[t or ""]), i == best(groups[t or ""]),
             sha256((t or "").encode()).hexdigest()) for i, t in rows]
    assert sorted(map(tuple, exact_groups(docs_of(rows), keep).collect())) == sorted(want)


def test_a_null_id_is_not_kept_beside_others(docs_of, odd_rows):
    rows = exact_groups(docs_of(odd_rows)).collect()
    assert [(r.keep_id, r.kept) for r in rows if r.doc_id is None] == [(2, False)]


def test_more_runs_than_numbers(spark):
    runs = spark.range(0, 1000, 1, 40).selectExpr(
        "id as doc_id", "cast(cast(id % 7 as string) as binary) as digest",
        "1L as n_bytes", "id % 7 as check_hash")
    from pyspark.sql import functions as F
    rows = merge_runs(runs, F.col("doc_id"), fan_in=2, rounds=2).collect()
    assert sorted(r.keep_id for r in rows) == list(range(993, 1000))
    assert sum(r.group_size for r in rows) == 1000


def test_dropping_keeps_columns(docs_of, odd_rows):
    docs = docs_of([r for r in odd_rows if r[0] is not None])
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 7, 8, 9, 11, 12]


def brute_fingerprint(text, words):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not parts:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(parts[i:i + words]).encode(), seed=42)
              for i in range(max(1, len(parts) - words + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, prints, distance):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                parent[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: least[find(k)] for k, i in enumerate(ids)}


def near_texts():
    rnd = random.Random(4)
    rows = []
    for family in range(12):
        base = [rnd.choice("abcdefghij") * rnd.randint(1, 5) for _ in range(120)]
        for _ in range(8):
            words = list(base)
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = "changed"
            rows.append((len(rows), " ".join(words)))
    return rows


def test_near_groups(docs_of, odd_rows):
    rows = near_texts()
    rows += [(i + 1000, t) for i, t in odd_rows if i is not None]
    got = simhash.near_groups(docs_of(rows)).collect()
    prints = {i: brute_fingerprint(t, 4) for i, t in rows}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == prints
    ids = sorted(prints)
    assert {r.doc_id: r.component_id for r in got} == brute_components(
        ids, [prints[i] for i in ids], 4)
    assert len(got) == len(rows)


def test_hot_keys_lose_no_link(docs_of, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_KEY", 2)  # read where the plan is made
    rows = near_texts()
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs_of(rows)).collect()}
    ids = [i for i, _ in rows]
    assert got == brute_components(ids, [brute_fingerprint(t, 4) for _, t in rows], 4)


def test_spanning_links_connect_what_is_linked():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 6, np.uint64)
    values = (base[rng.integers(0, 6, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(
        np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))).reshape(-1, 1)
    links = simhash.spanning_links(values, 4)
    a, b = (np.concatenate(x) for x in zip(*links))
    assert len(a) < len(values)
    assert (simhash.apart(values[a], values[b]) <= 4).all()
    prints = values.ravel().tolist()
    want = brute_components(list(range(300)), prints, 4)
    parent = dict(zip(range(300), range(300)))
    for _ in range(300):
        for x, y in zip(a.tolist(), b.tolist()):
            parent[x] = parent[y] = min(parent[x], parent[y])
    assert parent == want


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    rows = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.vertex: r.root for r in rows} == {
        **{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(docs_of):
    """Whatever fingerprints link, one stays: of null, empty and blank texts too, of repeated
    rows, and of different texts with one id."""
    rows = near_texts() + [(200, None), (201, ""), (202, " "), (300, "a b c d e"), (300, "a b c d e"),
                           (None, "f g h i j"), (None, "f g h i j"), (301, "k l"), (301, "m n")]
    docs = docs_of(rows)
    kept = simhash.drop_near_copies(docs).collect()
    groups = {}
    prints = [brute_fingerprint(t, 4) for _, t in rows]
    places = brute_components(list(range(len(rows))), prints, 4)
    for k, (i, text) in enumerate(rows):
        # Null ids last; of one id the smallest digest.
        rank = (i is None, i or 0, sha256((text or "").encode()).digest())
        groups[places[k]] = min(groups.get(places[k], (True, 1 << 60, b"")), rank)
    assert [c for c in kept[0].asDict()] == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, sha256((r.text or "").encode()).digest())
                  for r in kept) == sorted(groups.values())
    assert simhash.drop_near_copies(docs_of([])).count() == 0


def brute_removal(rows):
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - 49):
            first[data[p:p + 50]] = min(first.get(data[p:p + 50], 1 << 62), i)
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if first[data[p:p + 50]] < i:
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        yield i, len(data), sum(gone), spans, sha256(kept).hexdigest()


@pytest.mark.parametrize("block_bytes", [8 << 20, 4000])
def test_remove_repeats(docs_of, odd_rows, monkeypatch, block_bytes):
    monkeypatch.setattr("mailveil.llm.suffix_dedup.BLOCK_BYTES", block_bytes)
    if block_bytes < 10_000:
        monkeypatch.setattr("mailveil.llm.suffix_dedup.BUCKET_RANKS", 50)
    rnd = random.Random(3)
    passages = ["".join(rnd.choice("abc de\n") for _ in range(rnd.randint(30, 200)))
                for _ in range(20)] + ["a" * 300, "ab" * 100, "é" * 80]
    rows = []
    for i in range(200):
        text = "".join(
            rnd.choice(passages) if rnd.random() < .5 else
            "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 120)))
            for _ in range(rnd.randint(0, 6)))
        rows.append((i, text))
    rows += [(i + 500, t) for i, t in odd_rows if i is not None]
    got = sorted(map(tuple, remove_repeats(docs_of(rows)).collect()))
    assert got == sorted(brute_removal(rows))


@pytest.mark.parametrize("hot_ranks", [1 << 16, 20])
def test_a_short_footer_in_many_documents(docs_of, monkeypatch, hot_ranks):
    """Hot words are decided string by string, with the result of the usual way."""
    monkeypatch.setattr("mailveil.llm.suffix_dedup.BLOCK_BYTES", 6000)
    monkeypatch.setattr("mailveil.llm.suffix_dedup.HOT_RANKS", hot_ranks)
    rnd = random.Random(7)

    def noise(n):
        return "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))

    footer, passage = "-- sent from my telephone, all rights!! --", noise(90)
    rows = []
    for i in range(240):
        text = noise(rnd.randint(0, 120))
        if i % 3:
            # Few characters around it, so some strings with the footer are equal too.
            text += rnd.choice("xyz") * 8 + footer + rnd.choice("uvw") * 8
        if i % 40 == 1:
            text += passage
        rows.append((i if i % 10 else 5, text))
    want = sorted(brute_removal(rows))
    if hot_ranks == 20:
        from mailveil.llm import suffix_dedup
        seen = []
        real = suffix_dedup.hot_words
        monkeypatch.setattr(suffix_dedup, "hot_words", lambda r: seen.append(real(r)) or seen[-1])
    got = sorted(map(tuple, remove_repeats(docs_of(rows)).collect()))
    assert got == want and sum(r[2] for r in got) > 500
    if hot_ranks == 20:
        assert len(seen[0]) > 0


def test_null_ids_are_dealt_out(docs_of):
    rnd = random.Random(8)
    shared = "".join(rnd.choice("abcdefgh ") for _ in range(70))
    rows = [(None, f"{k} {shared}") for k in range(30)] + [(4, shared), (9, shared + "!")]
    out = remove_repeats(docs_of(rows), with_text=True).collect()
    assert len(out) == 32
    assert all(shared.encode() not in bytes(r.kept) for r in out if r.doc_id != 4)


def test_removal_of_odd_tables(docs_of):
    assert remove_repeats(docs_of([])).count() == 0
    same = "x" * 30 + "y" * 40
    rows = remove_repeats(docs_of([(None, same), (1, same)]), with_text=True).collect()
    assert {r.doc_id: (r.n_removed, bytes(r.kept)) for r in rows} == {
        None: (70, b""), 1: (0, same.encode())}
