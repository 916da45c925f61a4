"""Benchmark decontamination with a positional inverted index over the training documents.

The index is split by documents: a task indexes a block of documents at a time, the sorted
positions of each term in one list, and answers the test windows from it. Lists of a
window's terms are adjusted by their offsets in the window and intersected from the rarest
on. Postings never leave their task; only what was found does.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_blocks, with_columns

# Bytes of benchmark texts that are answered in one pass over the documents and sent to every
# task; a larger benchmark is answered in several passes.
PASS_BYTES = 16 << 20

# Words of digits, letters and everything outside ASCII; all else separates.
WORD_BYTES = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
SEPARATED = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b in set(WORD_BYTES) else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return (text or "").encode().translate(SEPARATED).split()


class Windows(NamedTuple):
    """The test side of one pass. ``terms`` numbers the words from 1; a window is a row of
    ``tables``, by length, together with the items that it stands in."""

    terms: dict[bytes, int]
    tables: dict[int, tuple[np.ndarray, list[list]]]


def test_windows(items: list[tuple], size: int) -> Windows:
    """Windows of ``size`` consecutive words of each item; one window of fewer if it has no
    more. Equal windows are kept once. Items without words have none."""
    terms: dict[bytes, int] = {}
    found: dict[tuple, set] = {}
    for item, text in items:
        ids = [terms.setdefault(w, len(terms) + 1) for w in words(text)]
        for i in range(max(1, len(ids) - size + 1) if ids else 0):
            found.setdefault(tuple(ids[i:i + size]), set()).add(item)
    tables: dict[int, tuple[list, list]] = {}
    for window, of in found.items():
        rows, owners = tables.setdefault(len(window), ([], []))
        rows.append(window)
        owners.append(sorted(of, key=str))
    return Windows(terms, {n: (np.array(r, np.int64), o) for n, (r, o) in tables.items()})


class BlockIndex:
    """Postings of a block: for each term its sorted positions. The documents stand one after
    another with a gap of one position that holds no word."""

    def __init__(self, documents: list[list[bytes]], terms: dict[bytes, int]):
        get, parts, gap = terms.get, [], np.zeros(1, np.int64)
        self.lengths = np.array([len(d) for d in documents], np.int64)
        for d in documents:
            parts += [np.fromiter((get(w, 0) for w in d), np.int64, len(d)), gap]
        ids = np.concatenate(parts) if parts else gap
        self.first = np.concatenate(([0], np.cumsum(self.lengths + 1)))
        at = np.flatnonzero(ids)
        order = np.argsort(ids[at], kind="stable")
        self.positions = at[order]
        self.counts = np.bincount(ids[at], minlength=len(terms) + 1)
        self.begin = np.concatenate(([0], np.cumsum(self.counts)))
        self.size = len(ids)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.begin[term]:self.begin[term + 1]]

    def phrase(self, window: np.ndarray) -> np.ndarray:
        """Where the window begins: the terms' lists, each less the term's offset,
        intersected from the rarest term on."""
        starts = None
        for k in np.argsort(self.counts[window], kind="stable"):
            listed = self.postings(window[k])
            if starts is None:
                starts = listed - k
                continue
            place = np.searchsorted(listed, starts + k)
            there = place < len(listed)
            there[there] = listed[place[there]] == starts[there] + k
            starts = starts[there]
            if not len(starts):
                break
        return starts

    def near(self, window: np.ndarray, reach: int) -> np.ndarray:
        """Positions of the rarest term that have every other term of the window within
        ``reach`` positions to either side, in any order, in the same document."""
        order = np.argsort(self.counts[window], kind="stable")
        at = self.postings(window[order[0]])
        low, high = self.document_bounds(at)
        low, high = np.maximum(low, at - reach), np.minimum(high, at + reach)
        for k in order[1:]:
            listed = self.postings(window[k])
            place = np.searchsorted(listed, low)
            there = place < len(listed)
            there[there] = listed[place[there]] <= high[there]
            at, low, high = at[there], low[there], high[there]
            if not len(at):
                break
        return at

    def document_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, side="right") - 1

    def document_bounds(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        doc = self.document_of(positions)
        return self.first[doc], self.first[doc] + self.lengths[doc] - 1

    def present(self, table: np.ndarray) -> np.ndarray:
        """The windows of which every term occurs in the block."""
        return np.flatnonzero((self.counts[table] > 0).all(axis=1))


def search_block(documents: list[list[bytes]], windows: Windows, reach: int | None):
    """For each document the hit spans, the items found, and the items found nearby."""
    index = BlockIndex(documents, windows.terms)
    exact: list[set] = [set() for _ in documents]
    nearby: list[set] = [set() for _ in documents]
    opened = np.zeros(index.size + 1, np.int64)
    for length, (table, owners) in windows.tables.items():
        for row in index.present(table):
            starts = index.phrase(table[row])
            np.add.at(opened, starts, 1)
            np.add.at(opened, starts + length, -1)
            for d in np.unique(index.document_of(starts)):
                exact[d].update(owners[row])
            if reach is not None:
                for d in np.unique(index.document_of(index.near(table[row], reach))):
                    nearby[d].update(owners[row])
    hit = np.cumsum(opened) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False]))))
    begins, ends = edges[::2], edges[1::2]
    doc = index.document_of(begins)
    spans: list[list] = [[] for _ in documents]
    for d, a, b in zip(doc, begins - index.first[doc], ends - index.first[doc]):
        spans[d].append((int(a), int(b)))
    return spans, exact, nearby


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def benchmark_passes(benchmark: DataFrame) -> list[list[tuple]]:
    """The items in lots of about PASS_BYTES; equal rows once. Each lot is collected alone."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter(
        F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lots = -(-total // PASS_BYTES)
    lot = F.pmod(F.xxhash64("item", "text"), F.lit(max(lots, 1)))
    return [[tuple(r) for r in items.filter(lot == k).collect()] for k in range(lots)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10,
                       reach: int | None = None, kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the ``kept`` columns, n_words, spans, items, near_items.

    ``spans`` are the maximal runs of words inside occurrences of windows, as word numbers
    from 0, the end excluded; ``items`` the item ids, as strings in order, with a window in
    the document; ``near_items``, if ``reach`` is given, those with a window whose words all
    stand within that many words of its rarest one, in any order (always a superset if
    ``reach`` is at least ``size``), else null.

    Null and empty texts have no words and no hits. Items without id, text or words are never
    found. Repeated items count once, repeated documents each give a row. Kept columns with the
    names of new ones are replaced, others not read. An empty benchmark gives rows without
    hits.
    """
    kept = [c for c in kept if c not in FOUND]
    rows = docs.select(*kept, F.col("text").alias("_text"))
    schema = with_columns(rows, "n_words long, spans array<struct<start:long,stop:long>>, "
                                "items array<string>, near_items array<string>")

    def one_pass(rows: DataFrame, lot: list[tuple]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(test_windows(lot, size))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = shared.value
            for batch in text_blocks(batches, text="_text"):
                documents = [words(t) for t in batch.column("_text").to_pylist()]
                spans, exact, nearby = search_block(documents, windows, reach)
                if "spans" in batch.schema.names:  # what earlier passes found
                    for d, row in enumerate(batch.select(FOUND[1:]).to_pylist()):
                        spans[d] = merge_spans(
                            [*spans[d], *((x["start"], x["stop"]) for x in row["spans"])])
                        exact[d].update(row["items"])
                        nearby[d].update(row["near_items"] or ())
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c) for c in [*kept, "_text"]],
                    pa.array([len(d) for d in documents], pa.int64()),
                    pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], SPANS),
                    pa.array([sorted(e) for e in exact], pa.list_(pa.string())),
                    pa.array([None if reach is None else sorted(n) for n in nearby],
                             pa.list_(pa.string())),
                ], schema.names)

        return rows.mapInArrow(run, schema)

    for lot in benchmark_passes(benchmark) or [[]]:
        rows = one_pass(rows, lot)
    return rows.drop("_text")


FOUND = ["n_words", "spans", "items", "near_items"]
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The findings as figures: n_hit words in spans, n_items, a digest of the items, and
    whether any word is hit."""
    found = find_contamination(docs, benchmark, size)
    return found.select(
        "doc_id", "n_words", hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit_words() > 0).alias("contaminated"))


def hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The documents without any hit, with all their columns; nothing is shuffled."""
    clash = {c: f"_own_{c}" for c in docs.columns if c in FOUND}
    rows = docs.withColumnsRenamed(clash)
    found = find_contamination(rows, benchmark, size, kept=tuple(rows.columns))
    return found.filter(hit_words() == 0).select(
        *[F.col(clash.get(c, c)).alias(c) for c in docs.columns])
