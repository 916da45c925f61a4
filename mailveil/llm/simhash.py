"""Near duplicates by SimHash fingerprints and deletion variants of their segments.

With ``distance`` bits allowed, a fingerprint is cut into so few segments that in one of them
two linked fingerprints differ by at most one bit. For each bit of a segment the segment
without that bit is a key; two segments that differ by at most one bit share a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import HOT_PARTS, hot_join, one_of_each, row_key, text_blocks, with_columns
from .components import connected_components

BITS = 64
ALL_BITS = list(range(BITS))
SEED = 42

# Shingles that are hashed and counted at a time, which bounds memory for a long text.
SHINGLES_AT_ONCE = 1 << 15

# A key with more fingerprints than this, and more than one part in HOT_PARTS of all, is
# split by variants of the other bits.
HOT_KEY = 50_000
# In keys with up to this many fingerprints all pairs are compared at once.
SMALL_KEY = 24


def fingerprint(text: str | None, words: int) -> int:
    """The fingerprint of the word shingles of a text, repeats included, as a signed number of
    64 bits; zero if it has no words, of the whole sequence if it has fewer than a shingle
    takes."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = (ends[words - 1:] if len(parts) >= words else ends[-1:]).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, n, SHINGLES_AT_ONCE):
        shingles = [joined[a:z] for a, z in zip(starts[i:i + SHINGLES_AT_ONCE],
                                                stops[i:i + SHINGLES_AT_ONCE])]
        hashes = np.array([digest(s, SEED) for s in shingles], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits((ones * 2 > n).astype(np.uint8), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int, *more: Column) -> DataFrame:
    """``(doc_id, print)``, and ``more`` columns as they are: the fingerprint of each document."""
    rows = docs.select(F.col("doc_id").cast("long"), *more, "text")
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            found = [fingerprint(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, kept), pa.array(found, pa.int64())], [*kept, "print"])

    return rows.mapInArrow(run, with_columns(rows.select(kept), "print long"))


def cut(bits: list[int], parts: int) -> list[list[int]]:
    size = -(-len(bits) // parts)
    return [bits[i:i + size] for i in range(0, len(bits), size)]


def mask(bits: list[int]) -> int:
    """The bits as a signed 64-bit number."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def variants(value: Column, segments: list[list[int]]) -> Column:
    """A key per bit: the number of the bit and its segment without it."""
    masks = F.array(*[
        F.struct(F.lit(bit).cast("short").alias("bit"),
                 F.lit(mask([b for b in segment if b != bit])).cast("long").alias("mask"))
        for segment in segments for bit in segment])
    return F.transform(masks, lambda m: F.struct(
        m["bit"].alias("bit"), value.bitwiseAND(m["mask"]).alias("rest")))


def hot_keys(prints: DataFrame, total: int, parts: int) -> DataFrame:
    """Keys ``(bit, rest)`` that a segment value with many fingerprints falls into.

    At most HOT_PARTS values per segment pass, so the table is bounded by their variants.
    """
    segments = cut(ALL_BITS, parts)
    values = F.array(*[
        F.struct(F.lit(i).alias("place"),
                 F.col("print").bitwiseAND(F.lit(mask(segment)).cast("long")).alias("value"))
        for i, segment in enumerate(segments)])
    hot = (
        prints.select(F.explode(values).alias("v")).groupBy("v.place", "v.value")
        .agg(F.count("*").alias("n"))
        .filter((F.col("n") > HOT_KEY) & (F.col("n") * F.lit(HOT_PARTS) > F.lit(total)))
    )
    keys = None
    for i, segment in enumerate(segments):
        here, found = F.col("place") == i, variants(F.col("value"), [segment])
        keys = F.when(here, found) if keys is None else keys.when(here, found)
    return hot.select(F.explode(keys).alias("k")).select("k.bit", "k.rest").distinct()


def second_keys(parts: int) -> Column:
    """For a row of a hot key: variants of the bits outside its segment."""
    out = None
    for segment in cut(ALL_BITS, parts):
        rest = cut([b for b in ALL_BITS if b not in segment], parts)
        keys = variants(F.col("print"), rest)
        here = F.col("bit").between(segment[0], segment[-1])
        out = F.when(here, keys) if out is None else out.when(here, keys)
    return out


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, row by row."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def spanning_links(values: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links, as places, that connect whatever is linked; fewer than there are values.

    Each value met is compared with those that no link has reached yet.
    """
    links, rest = [], np.arange(len(values))
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = apart(values[rest], values[at]) <= distance
            if near.any():
                links.append((np.full(near.sum(), at), rest[near]))
                front.extend(rest[near])
                rest = rest[~near]
    return links


def block_links(group: np.ndarray, values: np.ndarray, distance: int):
    """Links, as places, inside the groups of a block; equal groups stand together."""
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(group)])))
    size_of = np.repeat(sizes, sizes)
    links, shift = [(np.empty(0, np.int64),) * 2], 1
    small = np.flatnonzero((size_of > 1) & (size_of <= SMALL_KEY))
    while len(small):
        small = small[small + shift < len(group)]
        small = small[group[small + shift] == group[small]]
        near = small[apart(values[small], values[small + shift]) <= distance]
        links.append((near, near + shift))
        shift += 1
    for start, size in zip(starts[sizes > SMALL_KEY], sizes[sizes > SMALL_KEY]):
        links.extend((a + start, b + start)
                     for a, b in spanning_links(values[start:start + size], distance))
    return [np.concatenate(side) for side in zip(*links)]


def verified_links(keyed: DataFrame, distance: int) -> DataFrame:
    """Compare the fingerprints that share a key; rows of a key stand together."""
    key = ["bit", "rest", "bit2", "rest2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emit(rows):
            keys = rows[:, :len(key)]
            group = np.cumsum(np.concatenate(([0], (keys[1:] != keys[:-1]).any(axis=1))))
            values = np.ascontiguousarray(rows[:, len(key):]).view(np.uint64)
            a, b = block_links(group, values, distance)
            if len(a):
                prints = rows[:, len(key)]
                pairs = np.unique(np.stack((prints[a], prints[b])), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(p) for p in pairs], ["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                             for c in [*key, "print"]], axis=1)
            # The last key may go on in the next batch, and the first go on from the last.
            last = np.flatnonzero((rows[:, :len(key)] != rows[-1, :len(key)]).any(axis=1))
            end = last[-1] + 1 if len(last) else 0
            if held and (end or (held[-1][-1, :len(key)] != rows[0, :len(key)]).any()):
                yield from emit(np.concatenate((*held, rows[:end])))
                held, rows = [], rows[end:]
            elif end:
                yield from emit(rows[:end])
                rows = rows[end:]
            held.append(rows)
        if held:
            yield from emit(np.concatenate(held))

    return (
        keyed.repartition(*key).sortWithinPartitions(*key)
        .mapInArrow(run, "a long, b long").distinct()
    )


def links(prints: DataFrame, total: int, distance: int) -> DataFrame:
    """Links ``(a, b)`` among distinct fingerprints that connect what is linked."""
    # So many segments that no link can differ by two bits in each.
    parts = distance // 2 + 1
    none = F.array(F.struct(F.lit(-1).cast("short").alias("bit"),
                            F.lit(0).cast("long").alias("rest")))
    hot = hot_keys(prints, total, parts).withColumn("hot", F.lit(True))
    keyed = (
        prints.select("print", F.explode(variants(F.col("print"), cut(ALL_BITS, parts))).alias("k"))
        .select("print", "k.bit", "k.rest")
        .join(F.broadcast(hot), ["bit", "rest"], "left")
        .select("print", "bit", "rest", F.explode(
            F.when(F.col("hot"), second_keys(parts)).otherwise(none)).alias("k2"))
        .select("print", "bit", "rest",
                F.col("k2.bit").alias("bit2"), F.col("k2.rest").alias("rest2"))
    )
    return verified_links(keyed, distance)


def rooted_prints(slim: DataFrame, total: int, distance: int) -> DataFrame:
    """``(print, root, first, n)``: the component of each distinct fingerprint of ``slim(doc_id,
    print)``, its smallest id and its number of rows, as a written table."""
    groups = settle(
        slim.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")),
        "distinct-fingerprints")
    roots = connected_components(links(groups, total, distance))
    members = groups.join(roots, F.col("print") == F.col("vertex"), "left").select(
        "print", F.coalesce("root", "print").alias("root"), "first", "n")
    return settle(members, "members")


def near_groups(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (hexadecimal), component_id.

    Documents whose fingerprints differ in at most ``distance`` bits are linked; the
    component id is the smallest id that links reach.

    Null, empty and blank texts have the fingerprint zero and are linked like any other.
    Equal fingerprints are one in the search, so copies cost nothing there; repeated rows
    each give a row. A null id is no candidate for a component id unless its component has no
    other. Other columns are not read.
    """
    slim = settle(fingerprints(docs, words), "fingerprints")
    total = slim.count()
    members = rooted_prints(slim, total, distance)
    least = members.groupBy("root").agg(F.min("first").alias("component_id"))
    named = members.join(least, "root").select("print", "n", "component_id")
    return hot_join(slim, named, ["print"], "n", total).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """One document of each group that ``near_groups`` finds, with all its columns.

    The smallest id stays; of several texts with that id the one with the smallest digest, and
    of rows that repeat both a single one. A null id stays only where the group has no other.
    """
    slim = settle(fingerprints(docs, words, *row_key(docs)), "fingerprints")
    members = rooted_prints(slim, slim.count(), distance)
    # A row per fingerprint meets the components, whatever the number of copies.
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest", "rows"))
    rows = slim.groupBy("print", "doc_id", "digest").agg(F.count("*").alias("rows"))
    firsts = rows.groupBy("print").agg(best.alias("best"))
    kept = members.join(firsts, "print").groupBy("root").agg(F.min("best").alias("best"))
    return one_of_each(docs, settle(kept.select("best.doc_id", "best.digest", "best.rows"), "kept"))
