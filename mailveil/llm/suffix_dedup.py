"""Removal of byte strings that also start in an earlier document.

Suffixes are sorted by their first LENGTH bytes, one bucket at a time. The cover sample is
the positions where the hash of WORD bytes is the smallest of the words inside a string of
LENGTH bytes. As with a difference cover, any two equal strings hold a sampled position at
the same offset; here the text chooses the positions, so equal strings hold the same ones
and a sample of two positions in WIDTH + 1 does. Neighbouring strings with one sampled
position make a stretch.

1. Cover ranks: a block of documents sends a rank pair per sampled position, of its word and
   of its stretch, once for equal stretches and with the smallest document. Where two
   documents tie over a whole stretch, the ranks decide all its strings at once.
2. Suffix buckets: for words that more than one document has but in different stretches, the
   block sends the stretches themselves. A bucket sorts the suffixes of its stretches.
3. The blocks apply both decisions to their texts.

A short passage that very many documents have in different surroundings gives a word with a
stretch for each. Such hot words, few by their share of all sampled positions, take neither
way: the blocks send the strings of their stretches, each once with its smallest document,
and a task decides on strings by their hash, so no word is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import text_blocks

LENGTH = 50
WORD = 26
WIDTH = LENGTH - WORD + 1  # words inside a string

# Bytes and rows of a block, sampled positions of a bucket: what a task holds at a time.
BLOCK_BYTES = 8 << 20
BLOCK_ROWS = 50_000
BUCKET_RANKS = 1 << 20
# A word is hot if its stretches, distinct in each block, are more than one part in 2 * HOT_PARTS
# of all, and more than HOT_RANKS; so there are fewer than 2 * HOT_PARTS hot words.
HOT_PARTS = 1000
HOT_RANKS = 1 << 16
# Positions worked on at a time, and suffixes sorted at a time.
CHUNK = 1 << 18
SUFFIXES_AT_ONCE = 1 << 19

# Multipliers of the hashes: the first digits of the golden ratio and of the square root of
# two and three in binary, made odd.
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0x6A09E667F3BCC909, 0xBB67AE8584CAA73B)]
BYTE_HASHES = np.random.default_rng(50).integers(0, 1 << 63, 256, np.uint64) * ODD[0]
PLACE = np.uint64((1 << 24) - 1)  # the low bits of a word's hash give way to its position

NONE, WHOLE, SORT, HOT = 0, 1, 2, 3


def join_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two strings one after the other."""
    out = a * ODD[1]
    out += b
    out ^= out >> np.uint64(31)
    out *= ODD[2]
    return out


class Runs(NamedTuple):
    """Stretches: where the first string starts, how many there are, the sampled position's
    offset, and the hashes of word and stretch."""

    start: np.ndarray
    count: np.ndarray
    word: np.ndarray
    stretch: np.ndarray


def find_runs(data: np.ndarray, ends: np.ndarray) -> Runs:
    """The stretches of documents that stand one after another and end at ``ends``."""
    found = []
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    tails = ends[:, None] - np.arange(1, LENGTH)
    crossing = np.zeros(len(data) + 1, bool)
    crossing[tails[tails >= starts[:, None]]] = True
    for at in range(0, len(data) - LENGTH + 1, CHUNK):
        piece = data[at:at + CHUNK + LENGTH - 1]
        h1 = BYTE_HASHES[piece]
        h2 = join_hashes(h1[:-1], h1[1:])
        h4 = join_hashes(h2[:-2], h2[2:])
        h8 = join_hashes(h4[:-4], h4[4:])
        h16 = join_hashes(h8[:-8], h8[8:])
        n = len(piece) - WORD + 1
        words = join_hashes(join_hashes(h16[:n], h8[16:16 + n]), h2[24:24 + n])
        least = (words & ~PLACE) | np.arange(n, dtype=np.uint64)
        for step in (1, 2, 4, 8, WIDTH - 16):
            least = np.minimum(least[:-step], least[step:])
        sampled = (least & PLACE).astype(np.int64)
        good = ~crossing[at:at + len(sampled)]
        same = (sampled[1:] == sampled[:-1]) & good[1:] & good[:-1]
        first = np.flatnonzero(good & np.concatenate(([True], ~same)))
        last = np.flatnonzero(good & np.concatenate((~same, [True])))

        def string(p):
            return join_hashes(join_hashes(h16[p], h16[p + 16]),
                               join_hashes(h16[p + 32], h2[p + 48]))

        word = words[sampled[first]]
        shape = ((last - first) * LENGTH + sampled[first] - first).astype(np.uint64)
        found.append((first + at, last - first + 1, join_hashes(word, word),
                      join_hashes(join_hashes(string(first), string(last)), shape)))
    if not found:
        none = np.empty(0, np.int64)
        return Runs(none, none, none.astype(np.uint64), none.astype(np.uint64))
    return Runs(*(np.concatenate(x) for x in zip(*found)))


class Block:
    """The documents of a block in order of id, and its distinct stretches, each with the
    smallest document that has it, in order of bucket and hash. Stretches of hot words stand
    apart."""

    def __init__(self, table: pa.Table, buckets: int, hot: np.ndarray):
        ids = table.column("doc_id").to_numpy()
        texts = table.column("body").to_pylist()
        order = np.argsort(ids, kind="stable")
        if (np.diff(ids[order]) == 0).any():  # any order will do, but always the same
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i])))
        self.ids, self.rows = ids[order], order
        self.texts = [texts[i] for i in order]
        self.ends = np.cumsum([len(t) for t in self.texts])
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        runs = find_runs(self.data, self.ends)
        is_hot = np.isin(runs.word, hot)
        self.hot = Runs(*(x[is_hot] for x in runs))
        runs = self.runs = Runs(*(x[~is_hot] for x in runs))
        bucket = (runs.word % np.uint64(buckets)).astype(np.int64)
        self.doc = np.searchsorted(self.ends, runs.start, side="right")
        by = np.lexsort((self.doc, runs.stretch, runs.word, bucket))
        new = np.concatenate(([True], (runs.stretch[by][1:] != runs.stretch[by][:-1])
                              | (runs.word[by][1:] != runs.word[by][:-1])))[:len(by)]
        self.of = np.empty(len(by), np.int64)  # the distinct stretch of each run
        self.of[by] = np.cumsum(new) - 1
        self.first = by[new]  # a run of each distinct stretch, in its smallest document
        self.bucket = bucket[self.first]
        self.least = self.ids[self.doc[self.first]]

    def parts(self):
        """Bucket by bucket the range of its distinct stretches."""
        cuts = np.flatnonzero(np.diff(self.bucket)) + 1
        edges = np.concatenate(([0], cuts, [len(self.bucket)]))
        for a, b in zip(edges[:-1], edges[1:]):
            if b > a:
                yield int(self.bucket[a]), int(a), int(b)

    def hot_strings(self):
        """Where the strings of hot words start, the number of each string among the distinct
        ones, one place of each of these, and the smallest document that has it."""
        counts = self.hot.count
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.repeat(self.hot.start, counts) + offset
        doc = self.ids[np.searchsorted(self.ends, at, side="right")]
        by, new = string_order(string_keys(self.data, at), doc)
        of = np.empty(len(at), np.int64)
        of[by] = np.cumsum(new) - 1
        return at, doc, of, at[by[new]], doc[by[new]]

    def decisions(self, decided: pa.Table) -> np.ndarray:
        """What the cover ranks say of each distinct stretch."""
        out = np.zeros(len(self.first), np.uint8)
        ranges = {bucket: (a, b) for bucket, a, b in self.parts()}
        for bucket, kind, data in zip(*(decided.column(c).to_pylist()
                                        for c in ("bucket", "kind", "data"))):
            if kind == WHOLE:
                a, b = ranges[bucket]
                out[a:b] = np.frombuffer(data, np.uint8)
        return out


def string_keys(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The strings at ``starts``, eight bytes at a time as a number."""
    if not len(starts):
        return np.empty((0, -(-LENGTH // 8)), np.uint64)
    strings = np.zeros((len(starts), -(-LENGTH // 8) * 8), np.uint8)
    strings[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[starts]
    return strings.view(">u8").astype(np.uint64)


def string_order(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by string and document, and in it where another string begins."""
    by = np.lexsort((doc, *keys.T[::-1]))
    sorted_keys = keys[by]
    new = np.ones(len(by), bool)
    new[1:] = (sorted_keys[1:] != sorted_keys[:-1]).any(axis=1)
    return by, new


def packed(numbers: np.ndarray, size: int) -> bytes:
    """The low bytes of each number."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpacked(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


def table_of(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


SENT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("words", pa.binary()),
                  ("stretches", pa.binary()), ("places", pa.binary()), ("ids", pa.binary())])
DECIDED = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()),
                     ("data", pa.binary())])
STRINGS = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("strings", pa.binary()),
                     ("ids", pa.binary()), ("which", pa.binary())])
RAW = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("lengths", pa.binary()),
                 ("texts", pa.binary()), ("ids", pa.binary()), ("which", pa.binary())])


def heavy_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with a large share of the stretches of some texts, and in a row without a word how
    many there are; at most 2 * HOT_PARTS words for BLOCK_BYTES of text."""
    for batch in text_blocks(batches, BLOCK_BYTES, "body"):
        texts = batch.column("body").to_pylist()
        runs = find_runs(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]))
        words, n = np.unique(runs.word, return_counts=True)
        held = np.isin(runs.word, words[n * 2 * HOT_PARTS > len(runs.word)])
        # Only those are worth telling how many of their stretches differ.
        pairs = np.unique(np.stack((runs.word[held], runs.stretch[held])), axis=1)
        words, n = np.unique(pairs[0], return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*words.view(np.int64).tolist(), None], pa.int64()),
             pa.array([*n.tolist(), len(runs.word)], pa.int64())], ["word", "n"])


def send_hot(buckets: int, hot: np.ndarray, parts: int):
    """The strings of hot words of a block, each once, by the hash of the string."""
    def run(table: pa.Table) -> pa.Table:
        block, rows = Block(table, buckets, hot), []
        _, _, _, place, least = block.hot_strings()
        keys, number = string_keys(block.data, place), table.column("block")[0].as_py()
        mixed = np.zeros(len(keys), np.uint64)
        for column in keys.T:
            mixed = join_hashes(mixed, column)
        part = (mixed % np.uint64(parts)).astype(np.int64)
        for k in np.unique(part):
            which = np.flatnonzero(part == k)
            rows.append({"part": int(k), "block": number, "strings": keys[which].tobytes(),
                         "ids": least[which].astype("<i8").tobytes(),
                         "which": which.astype("<u4").tobytes()})
        return table_of(rows, STRINGS)

    return run


def decide_hot(table: pa.Table) -> pa.Table:
    """Which strings a smaller document in another block has too."""
    columns = {c: table.column(c).to_pylist() for c in STRINGS.names}
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in columns["strings"]]).reshape(
        -1, -(-LENGTH // 8))
    ids = np.concatenate([np.frombuffer(x, "<i8") for x in columns["ids"]])
    which = np.concatenate([np.frombuffer(x, "<u4") for x in columns["which"]])
    block = np.repeat(columns["block"], [len(x) // 4 for x in columns["which"]])
    by, new = string_order(keys, ids)
    later = np.empty(len(by), bool)
    later[by] = ids[by] > ids[by][new][np.cumsum(new) - 1]
    return table_of([{"block": int(b), "bucket": 0, "kind": HOT,
                      "data": which[later & (block == b)].tobytes()}
                     for b in np.unique(block[later])], DECIDED)


def send_ranks(buckets: int, hot: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        block, number, rows = Block(table, buckets, hot), table.column("block")[0].as_py(), []
        for bucket, a, b in block.parts():
            ids, places = np.unique(block.least[a:b], return_inverse=True)
            runs = block.first[a:b]
            rows.append({
                "bucket": bucket, "block": number,
                "words": packed(block.runs.word[runs] >> np.uint64(16), 6),
                "stretches": packed(block.runs.stretch[runs] >> np.uint64(16), 6),
                "places": places.astype("<u2").tobytes(), "ids": ids.astype("<i8").tobytes()})
        return table_of(rows, SENT)

    return run


def decide_ranks(table: pa.Table) -> pa.Table:
    """A stretch that a smaller document has too goes as a whole; if the word has several
    stretches and documents, the smallest document of each stretch must be sorted."""
    columns = [table.column(c).to_pylist() for c in ("words", "stretches", "places", "ids")]
    word = np.concatenate([unpacked(x, 6) for x in columns[0]])
    stretch = np.concatenate([unpacked(x, 6) for x in columns[1]])
    doc = np.concatenate([np.frombuffer(i, "<i8")[np.frombuffer(p, "<u2")]
                          for p, i in zip(columns[2], columns[3])])
    sizes = np.array([len(p) // 2 for p in columns[2]])
    by = np.lexsort((doc, stretch, word))
    w, s, d = word[by], stretch[by], doc[by]
    new_word = np.concatenate(([True], w[1:] != w[:-1]))
    new_stretch = new_word | np.concatenate(([True], s[1:] != s[:-1]))
    group, part = np.cumsum(new_word) - 1, np.cumsum(new_stretch) - 1
    at = np.flatnonzero(new_word)
    least, most = np.minimum.reduceat(d, at), np.maximum.reduceat(d, at)
    several = (np.add.reduceat(new_stretch, at) > 1) & (least < most)
    first = d[np.flatnonzero(new_stretch)][part]
    code = np.where(d > first, WHOLE, np.where(several[group], SORT, NONE)).astype(np.uint8)
    out = np.empty(len(by), np.uint8)
    out[by] = code
    rows, start = [], 0
    for number, bucket, size in zip(table.column("block").to_pylist(),
                                    table.column("bucket").to_pylist(), sizes):
        codes = out[start:start + size]
        start += size
        if codes.any():
            rows.append({"block": number, "bucket": bucket, "kind": WHOLE, "data": codes.tobytes()})
    return table_of(rows, DECIDED)


def send_stretches(buckets: int, hot: np.ndarray):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block, rows = Block(left, buckets, hot), []
        codes = block.decisions(right)
        for bucket, a, b in block.parts():
            which = np.flatnonzero(codes[a:b] == SORT) + a
            if not len(which):
                continue
            runs = block.first[which]
            starts, lengths = block.runs.start[runs], block.runs.count[runs] + LENGTH - 1
            rows.append({
                "bucket": bucket, "block": left.column("block")[0].as_py(),
                "lengths": lengths.astype("<u1").tobytes(),
                "texts": b"".join([block.data[p:p + n].tobytes() for p, n in zip(starts, lengths)]),
                "ids": block.least[which].astype("<i8").tobytes(),
                "which": which.astype("<u4").tobytes()})
        return table_of(rows, RAW)

    return run


def later_suffixes(text: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which of the strings at ``starts`` also start in a smaller document: the suffixes are
    sorted by their first LENGTH bytes, eight at a time as a number, then by document."""
    by, new = string_order(string_keys(text, starts), doc)
    d = doc[by]
    first = d[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.empty(len(by), bool)
    out[by] = d > first
    return out


def sort_suffixes(table: pa.Table) -> pa.Table:
    """Sort the suffixes of a bucket part by part: by the hash of their first bytes, so that
    equal ones are in the same part and a part has about SUFFIXES_AT_ONCE."""
    columns = {c: table.column(c).to_pylist() for c in RAW.names}
    lengths = np.concatenate([np.frombuffer(x, "<u1") for x in columns["lengths"]]).astype(np.int64)
    ids = np.concatenate([np.frombuffer(x, "<i8") for x in columns["ids"]])
    which = np.concatenate([np.frombuffer(x, "<u4") for x in columns["which"]])
    block = np.repeat(columns["block"], [len(x) for x in columns["lengths"]])
    text = np.frombuffer(b"".join(columns["texts"]), np.uint8)
    counts = lengths - LENGTH + 1
    of = np.repeat(np.arange(len(lengths)), counts)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(np.cumsum(lengths) - lengths, counts) + offset
    head = BYTE_HASHES[text]
    head = join_hashes(join_hashes(head[:-3], head[1:-2]), join_hashes(head[2:-1], head[3:]))
    parts = len(starts) // SUFFIXES_AT_ONCE + 1
    part = head[starts] % np.uint64(parts)
    later = np.zeros(len(starts), bool)
    for k in range(parts):
        these = np.flatnonzero(part == k)
        if len(these):
            later[these] = later_suffixes(text, starts[these], ids[of[these]])
    hit = np.flatnonzero(later)
    hit = hit[np.argsort(block[of[hit]], kind="stable")]
    rows = []
    for number in np.unique(block[of[hit]]):
        these = hit[block[of[hit]] == number]
        data = np.stack((which[of[these]].astype("<u4"), offset[these].astype("<u4")), axis=1)
        rows.append({"block": int(number), "bucket": 0, "kind": SORT, "data": data.tobytes()})
    return table_of(rows, DECIDED)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                    ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def apply_decisions(buckets: int, hot: np.ndarray, with_text: bool):
    schema = RESULT.append(pa.field("kept", pa.binary())) if with_text else RESULT

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, buckets, hot)
        codes = block.decisions(right)
        runs, opened = block.runs, np.zeros(len(block.data) + 1, np.int32)
        # In a block the smallest document of a stretch stands for all, and the others go.
        smallest = block.ids[block.doc] == block.least[block.of]
        whole = np.flatnonzero(~smallest | (codes[block.of] == WHOLE))
        np.add.at(opened, runs.start[whole], 1)
        np.add.at(opened, runs.start[whole] + runs.count[whole] + LENGTH - 1, -1)
        found = [np.frombuffer(d, "<u4").reshape(-1, 2) for k, d in zip(
            right.column("kind").to_pylist(), right.column("data").to_pylist()) if k == SORT]
        if found:
            which, offset = np.concatenate(found).astype(np.int64).T
            by = np.argsort(block.of, kind="stable")
            sizes = np.bincount(block.of, minlength=len(block.first))
            begin = np.cumsum(sizes) - sizes
            times = sizes[which]
            place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            at = runs.start[by[np.repeat(begin[which], times) + place]] + np.repeat(offset, times)
            np.add.at(opened, at, 1)
            np.add.at(opened, at + LENGTH, -1)
        if len(block.hot.start):
            at, doc, of, _, least = block.hot_strings()
            later = doc > least[of]
            for kind, data in zip(right.column("kind").to_pylist(), right.column("data").to_pylist()):
                if kind == HOT:
                    gone = np.zeros(len(least), bool)
                    gone[np.frombuffer(data, "<u4")] = True
                    later |= gone[of]
            np.add.at(opened, at[later], 1)
            np.add.at(opened, at[later] + LENGTH, -1)
        removed = np.cumsum(opened[:-1]) > 0
        rows, start = [], 0
        for i, end in zip(block.ids.tolist(), block.ends.tolist()):
            gone, body = removed[start:end], block.data[start:end]
            kept = body[~gone].tobytes()
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].any())
            row = {"doc_id": None if i == NO_ID else i, "n_bytes": end - start,
                   "n_removed": int(gone.sum()), "n_spans": spans,
                   "kept_sha256": sha256(kept).hexdigest()}
            rows.append(row | ({"kept": kept} if with_text else {}))
            start = end
        return table_of(rows, schema)

    return run


NO_ID = (1 << 63) - 1  # stands for a null id, which is larger than any


def hot_words(rows: DataFrame) -> np.ndarray:
    """The hashes of hot words; fewer than 2 * HOT_PARTS reach the driver."""
    counts = settle(rows.select("body").mapInArrow(heavy_words, "word long, n long").groupBy(
        "word").agg(F.sum("n").alias("n")), "heavy-words")
    total = counts.filter("word is null").agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("word").isNotNull() & (F.col("n") > HOT_RANKS)
                        & (F.col("n") * 2 * HOT_PARTS > total))
    return np.array([r.word for r in hot.select("word").collect()], np.int64).view(np.uint64)


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept``,
    the remaining bytes, if asked for.

    Every byte inside a string of LENGTH bytes that also starts in a document with a smaller
    id goes; strings are those of the input. A null text is empty; texts shorter than LENGTH
    lose nothing. A null id is larger than any other; rows are dealt out by id and text, so
    neither null ids nor a repeated one make a large block. Rows with the same id are the same
    document and take nothing from each other; each gives a row. Other columns are not read.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("body"))).first()
    blocks = max((size or 0) // BLOCK_BYTES, n // BLOCK_ROWS) + 1
    buckets = (size or 0) * 2 // (WIDTH + 1) // BUCKET_RANKS + 1
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "body"), F.lit(blocks)))
    hot = hot_words(rows)

    ranks = rows.groupBy("block").applyInArrow(
        send_ranks(buckets, hot), "bucket long, block long, words binary, stretches binary, "
                             "places binary, ids binary")
    decided_schema = "block long, bucket long, kind int, data binary"
    whole = ranks.groupBy("bucket").applyInArrow(decide_ranks, decided_schema)
    stretches = rows.groupBy("block").cogroup(whole.groupBy("block")).applyInArrow(
        send_stretches(buckets, hot), "bucket long, block long, lengths binary, texts binary, "
                                 "ids binary, which binary")
    sorted_out = stretches.groupBy("bucket").applyInArrow(sort_suffixes, decided_schema)
    decided = whole.unionByName(sorted_out)
    if len(hot):
        strings = rows.groupBy("block").applyInArrow(
            send_hot(buckets, hot, blocks),
            "part long, block long, strings binary, ids binary, which binary")
        decided = decided.unionByName(
            strings.groupBy("part").applyInArrow(decide_hot, decided_schema))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.groupBy("block").cogroup(decided.groupBy("block")).applyInArrow(
        apply_decisions(buckets, hot, with_text), out + (", kept binary" if with_text else ""))
