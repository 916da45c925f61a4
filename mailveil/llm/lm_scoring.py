"""A hashed maximum-entropy language model with class-factored softmax.

The probability of a word is that of its class given the two words before, times its share of
the class. Frequent words have classes of their own, others are in the class of their
hashed ending. The class is predicted by a softmax in two stages. The first has coarse
features: the class of the word before, of the one before that (a skip), and both as a pair.
All text is summed up as counts of (context, class), and training takes gradients over those.

The second has features of whole words, whatever their number: each history has one key, the word
before, or behind one of the most frequent words, which the first stage tells apart, the word it
skips to. The weights of a word and class depend on the histories with that key alone, so
each word is fitted by itself where its counts are. Those of the most frequent words are sent to every
task; all others meet their occurrences by word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import text_blocks

END = b""  # no word is empty

# Words with a class of their own, then classes of hashed endings; the same for contexts,
# which are coarser, and one context for the start of a text.
OWN, ENDINGS = 80, 48
CLASSES = OWN + ENDINGS
CONTEXT_OWN, CONTEXT_ENDINGS = 40, 24
CONTEXTS = CONTEXT_OWN + CONTEXT_ENDINGS + 1
START = CONTEXTS - 1
ENDING_BYTES = 3

# The bias, both words and each pair of them: the size of the first stage.
FEATURES = 1 + 2 * CONTEXTS + CONTEXTS * CONTEXTS
ACTIVE = 4  # features of one event
SLICE = 256  # features whose gradients travel together

STEPS = 12
RIDGE = 0.5

# Features of whole words: a key is the word before (BEFORE) beside each coarse context of the other
# word, or the skipped word (SKIP) beside each frequent word between.
BEFORE, SKIP = 0, 1
SIDES = CONTEXTS + CONTEXT_OWN
WORD_CELLS = 2 * CLASSES + SIDES
WORD_STEPS = 4
# Events of the first stage that stand beside a key's own.
PRIOR = 10.0

# The most frequent words are sent to every task with their counts and weights, longer ones as a
# digest; all others meet theirs by word. Bounds what is broadcast.
HEAD, HEAD_BYTES = 1 << 15, 32
# Frequent words that are fitted, and rows of other words that are looked at, together.
FITTED_AT_ONCE, ROWS_AT_ONCE = 64, 1 << 14
# Words that a task counts before it passes the counts on.
COUNTED_AT_ONCE = 300_000


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def count_tokens(docs: DataFrame, learn: Column | None = None) -> DataFrame:
    """``(token, c, m)``, counted in the tasks before anything is shuffled: ``c`` over the texts
    that are learned from, by default all, and ``m`` over all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()

        def emit():
            for part, learned in zip(counts, (False, True)):
                n = pa.array(list(part.values()), pa.int64())
                c = n if learned else pa.array(np.zeros(len(n), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(part), pa.binary()), c, n], ["token", "c", "m"])
                part.clear()

        for batch in text_blocks(batches):
            for text, learned in zip(batch.column("text").to_pylist(),
                                     batch.column("learn").to_pylist()):
                counts[learned].update(tokens(text))
            if sum(map(len, counts)) > COUNTED_AT_ONCE:
                yield from emit()
        yield from emit()

    return (docs.select("text", learned_from(learn))
            .mapInArrow(run, "token binary, c long, m long")
            .groupBy("token").agg(F.sum("c").alias("c"), F.sum("m").alias("m")))


def learned_from(learn: Column | None) -> Column:
    return F.coalesce(F.lit(True) if learn is None else learn, F.lit(False)).alias("learn")


def digest(word: bytes) -> bytes:
    """What stands for a long word in the head; an end cannot stand inside a word."""
    return b" " + sha256(word).digest()


class Head:
    """The frequent words: their places, and by place count, class and context."""

    def __init__(self, rows: list[tuple[bytes, int, int]]):
        self.place = {word: i for i, (word, _, _) in enumerate(rows)}
        self.count = np.array([c for _, c, _ in rows], np.int64)
        endings = np.array([hashed for _, _, hashed in rows], np.int64)
        turn = np.arange(len(rows))
        self.kind = np.where(turn < OWN, turn, OWN + endings % ENDINGS)
        self.context = np.where(turn < CONTEXT_OWN, turn, CONTEXT_OWN + endings % CONTEXT_ENDINGS)

    def look_up(self, words: list[bytes]):
        """Places (-1 for a word outside the head), classes and contexts."""
        place = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        kind, context = np.empty_like(place), np.empty_like(place)
        other = np.flatnonzero(place < 0)
        for i in other.tolist():
            if len(words[i]) > HEAD_BYTES:
                place[i] = self.place.get(digest(words[i]), -1)
        known, other = place >= 0, other[place[other] < 0]
        kind[known], context[known] = self.kind[place[known]], self.context[place[known]]
        hashed = np.array([ending(words[i]) for i in other], np.int64)
        kind[other] = OWN + hashed % ENDINGS
        context[other] = CONTEXT_OWN + hashed % CONTEXT_ENDINGS
        return place, kind, context


def ending(word: bytes) -> int:
    return crc32(word[-ENDING_BYTES:])


def histories(context: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The number of the two contexts before each token; texts begin at ``starts``."""
    before = np.concatenate(([START], context[:-1]))
    before[starts] = START
    skipped = np.concatenate(([START], before[:-1]))
    skipped[starts] = START
    return skipped * CONTEXTS + before


def keys(history: np.ndarray):
    """For each token how far back its key is (0 if it has none), and its side: the other
    word's context, numbered on behind those where the key is a skipped word."""
    skipped, before = history // CONTEXTS, history % CONTEXTS
    shared = (before >= CONTEXT_OWN) & (before != START)
    behind = (before < CONTEXT_OWN) & (skipped >= CONTEXT_OWN) & (skipped != START)
    return shared + 2 * behind, np.where(shared, skipped, CONTEXTS + before)


def head_words(counts: DataFrame) -> Head:
    """The words from the highest counts down, in steps of about a tenth, as long as no more
    than HEAD are in; so nothing is sorted, and no more than those reach the driver."""
    words = counts.filter(F.col("token") != F.lit(END))
    step = F.floor(F.log2("m") * 8).cast("int")
    sizes = words.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
    least, held = 1 << 30, 0
    for row in sorted(sizes, key=lambda r: -r.step):
        held += row.n
        if held > HEAD:
            break
        least = row.step
    named = F.when(F.octet_length("token") <= HEAD_BYTES, F.col("token")).otherwise(
        F.concat(F.lit(b" "), F.unhex(F.sha2("token", 256))))
    rows = words.filter(step >= least).select(
        named.alias("token"), "c",
        F.substring("token", -ENDING_BYTES, ENDING_BYTES).alias("last")).toArrow().to_pydict()
    ordered = sorted(zip(rows["token"], rows["c"], map(ending, rows["last"])),
                     key=lambda r: (-r[1], r[0]))
    end = counts.filter(F.col("token") == F.lit(END)).first()
    return Head([(END, end.c if end else 0, ending(END)), *ordered])


def class_totals(counts: DataFrame, head: Head) -> np.ndarray:
    """For each class the tokens and distinct tokens in training, from their exact counts."""
    shared = counts.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            _, kind, _ = shared.value.look_up(batch.column("token").to_pylist())
            c = batch.column("c").to_numpy()
            np.add.at(n, kind, c)
            np.add.at(v, kind, c > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(CLASSES)), pa.array(n), pa.array(v)], ["kind", "n", "v"])

    rows = counts.mapInArrow(run, "kind long, n long, v long").groupBy("kind").agg(
        F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    totals = np.zeros((2, CLASSES), np.int64)
    for row in rows:
        totals[:, row.kind] = row.n, row.v
    return totals


def count_events(docs: DataFrame, head: Head) -> DataFrame:
    """``(history, kind, n)``: how often a class follows a coarse history, over all texts."""
    return count_cells(docs, head).filter("kind is not null")


def count_cells(docs: DataFrame, head: Head) -> DataFrame:
    """The rows of ``count_events`` and, with a null ``kind``, the cells of frequent words as
    keys, WORD_CELLS for each: classes behind the word, classes one further, and sides. Words
    outside the head are counted where they are fitted."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        cells = np.zeros(CONTEXTS * CONTEXTS * CLASSES, np.int64)
        own = np.zeros(len(head.count) * WORD_CELLS, np.int32)
        for batch in text_blocks(batches):
            texts = [tokens(t) for t in batch.column("text").to_pylist()]
            starts = np.cumsum([0, *map(len, texts[:-1])])
            place, kind, context = head.look_up([w for t in texts for w in t])
            history = histories(context, starts)
            np.add.at(cells, history * CLASSES + kind, 1)
            back, side = keys(history)
            at = np.flatnonzero(back)
            key = place[at - back[at]]
            at, key = at[key >= 0], key[key >= 0] * WORD_CELLS
            np.add.at(own, key + (back[at] - 1) * CLASSES + kind[at], 1)
            np.add.at(own, key + 2 * CLASSES + side[at], 1)
        for counted, width in ((cells, CLASSES), (own, 0)):
            codes = np.flatnonzero(counted)
            for i in range(0, len(codes), 1 << 16):
                part = codes[i:i + (1 << 16)]
                n = pa.array(counted[part].astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part // width), pa.array((part % width).astype(np.int32)), n]
                    if width else [pa.array(part), pa.nulls(len(part), pa.int32()), n],
                    ["history", "kind", "n"])

    return docs.select("text").mapInArrow(run, "history long, kind int, n long").groupBy(
        "history", "kind").agg(F.sum("n").alias("n"))


def active_features(history: np.ndarray) -> np.ndarray:
    """The places of a history's features, a row per feature."""
    skipped, before = history // CONTEXTS, history % CONTEXTS
    return np.stack((np.zeros_like(history), 1 + before, 1 + CONTEXTS + skipped,
                     1 + 2 * CONTEXTS + history))


def class_logs(weights: np.ndarray, history: np.ndarray) -> np.ndarray:
    """Natural logarithms of the class probabilities, a row per history."""
    logits = weights[active_features(history)].sum(axis=0)
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def train(events: DataFrame, steps: int = STEPS) -> np.ndarray:
    """Weights by steps along the gradient, each summed over all events.

    Tasks add up the gradients of their histories, these are added by slices of features,
    and only the model's own size reaches the driver. A step is scaled for each weight by
    what its feature holds, so rare and frequent ones learn alike.
    """
    context = events.sparkSession.sparkContext
    weights = np.zeros((FEATURES, CLASSES))

    for _ in range(steps):
        shared = context.broadcast(weights)

        def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros((CONTEXTS * CONTEXTS, CLASSES))
            for batch in batches:
                h, k, n = (batch.column(c).to_numpy() for c in ("history", "kind", "n"))
                np.add.at(seen, (h, k), n)
            history = np.flatnonzero(seen.sum(axis=1))
            seen = seen[history]
            expected = np.exp(class_logs(shared.value, history)) * seen.sum(axis=1, keepdims=True)
            sums = np.zeros((FEATURES, 2, CLASSES))
            for row in active_features(history):
                np.add.at(sums, row, np.stack((seen, expected), axis=1))
            starts = [i for i in range(0, FEATURES, SLICE) if sums[i:i + SLICE].any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(starts, pa.int64()),
                 pa.array([sums[i:i + SLICE].tobytes() for i in starts], pa.binary())],
                ["start", "sums"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(s) for s in table.column("sums").to_pylist())
            return pa.table({"start": table.column("start")[:1],
                             "sums": pa.array([total.tobytes()], pa.binary())})

        kind = "start long, sums binary"
        for row in events.mapInArrow(gradients, kind).groupBy("start").applyInArrow(add, kind).collect():
            seen, expected = np.frombuffer(row.sums).reshape(-1, 2, CLASSES).transpose(1, 0, 2)
            part = weights[row.start:row.start + SLICE]
            gradient = seen - expected - RIDGE * part
            part += 2 * gradient / (ACTIVE * (np.maximum(seen, expected) + RIDGE))
        shared.unpersist()
    return weights


def fit(seen: np.ndarray, sides: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of keys, a row for each, and the logarithm of what divides them beside each side.

    ``seen`` counts classes, ``sides`` the sides they were seen beside, and ``base`` has the
    first stage's probabilities of classes beside a side. A class that was never seen has weight
    0. Each step scales what is expected to what was seen, with PRIOR events of the first stage.
    """
    rows, kinds = np.nonzero(seen)
    total = np.maximum(sides.sum(axis=1, keepdims=True), 1)
    usual = PRIOR * sides / total
    mass = sides + usual
    wanted = seen[rows, kinds] + (usual @ base)[rows, kinds]
    gain = np.zeros_like(seen)
    gain[rows, kinds] = 1
    unseen = np.maximum(1 - gain @ base.T, 0)
    left = (usual * unseen).sum(axis=1)
    weights, own = np.zeros_like(seen), np.zeros(len(rows), np.float32)
    gain[:] = 0
    for _ in range(WORD_STEPS):
        shares = mass / (1 + gain @ base.T)
        expected = (shares @ base)[rows, kinds] * np.exp(own)
        others = (shares * unseen).sum(axis=1)
        scale = np.where((left > 1e-6) & (others > 1e-6), others / np.maximum(left, 1e-6), 1)
        own += np.log(wanted / expected * scale[rows])
        gain[rows, kinds] = np.expm1(own)
    weights[rows, kinds] = own
    weights = weights.astype(np.float16)
    return weights, np.log1p(np.expm1(weights.astype(np.float32)) @ base.T)


def fit_words(cells: np.ndarray, context: np.ndarray, probs: np.ndarray):
    """Weights of words, as ``(word, BEFORE or SKIP, class)``, and their rooms beside each side.
    ``cells`` are the WORD_CELLS of each word; words of one coarse context share a base."""
    weights = np.zeros((len(cells), 2, CLASSES), np.float16)
    rooms = np.zeros((len(cells), SIDES), np.float32)
    for own in np.unique(context):
        at = np.flatnonzero(context == own)
        for way, base, sides in ((BEFORE, probs[:, own], slice(0, CONTEXTS)),
                                 (SKIP, probs[own, :CONTEXT_OWN], slice(CONTEXTS, SIDES))):
            seen = cells[at, way * CLASSES:(way + 1) * CLASSES]
            weights[at, way], rooms[at, sides] = fit(seen, cells[at, 2 * CLASSES:][:, sides], base)
    return weights, rooms


def table_of(logs: np.ndarray) -> np.ndarray:
    """Probabilities of the first stage as ``(skipped, before, class)``."""
    return np.exp(logs).astype(np.float32).reshape(CONTEXTS, CONTEXTS, CLASSES)


def fit_head(cells: DataFrame, head: Head, logs: np.ndarray):
    """Weights and rooms of the frequent words, fitted some at a time in the tasks."""
    shared = cells.sparkSession.sparkContext.broadcast((head.context, logs))
    size = len(head.count)

    def run(counted: pa.Table) -> pa.Table:
        context, logs = shared.value
        chunk = counted.column("chunk")[0].as_py()
        own = context[chunk * FITTED_AT_ONCE:(chunk + 1) * FITTED_AT_ONCE]
        held = np.zeros(len(own) * WORD_CELLS, np.float32)
        held[counted.column("cell").to_numpy() - chunk * FITTED_AT_ONCE * WORD_CELLS] = (
            counted.column("n").to_numpy())
        weights, rooms = fit_words(held.reshape(-1, WORD_CELLS), own, table_of(logs))
        return pa.table({"chunk": counted.column("chunk")[:1],
                         "weights": pa.array([weights.tobytes()], pa.binary()),
                         "rooms": pa.array([rooms.tobytes()], pa.binary())})

    weights = np.zeros((size, 2, CLASSES), np.float16)
    rooms = np.zeros((size, SIDES), np.float32)
    chunk = F.floor(F.col("history") / (WORD_CELLS * FITTED_AT_ONCE)).cast("long")
    fitted = (
        cells.filter("kind is null").select(chunk.alias("chunk"), F.col("history").alias("cell"), "n")
        .groupBy("chunk").applyInArrow(run, "chunk long, weights binary, rooms binary"))
    for row in fitted.collect():
        at = slice(row.chunk * FITTED_AT_ONCE, (row.chunk + 1) * FITTED_AT_ONCE)
        weights[at] = np.frombuffer(row.weights, np.float16).reshape(-1, 2, CLASSES)
        rooms[at] = np.frombuffer(row.rooms, np.float32).reshape(-1, SIDES)
    return weights, rooms


def whole_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of ``word``, cut between two words into tables of some ROWS_AT_ONCE."""
    held, n, enough = [], 0, ROWS_AT_ONCE
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n < enough:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        words = rows.column("word")
        last = pc.index(words, words[-1]).as_py()
        if last:
            yield rows.slice(0, last)
        held, n = rows.slice(last).to_batches(), n - last
        # One word may hold more than that.
        enough = max(ROWS_AT_ONCE, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def judge_rare(rare: DataFrame, logs: np.ndarray) -> DataFrame:
    """``(row, more_known, more_mass, more_part)`` of each document with words outside the head.

    All occurrences of a word meet: those in training tell its count and fit its weights, which
    add to what the first stage says of the tokens behind each occurrence. Such a word holds no
    more than about one part in HEAD of all tokens.
    """
    shared = rare.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probs = table_of(shared.value)
        for rows in whole_words(batches):
            coded = rows.column("word").chunk(0).dictionary_encode()
            words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            learn = rows.column("learn").to_numpy()
            cells = np.zeros((len(words), WORD_CELLS), np.float32)
            events = []
            for way, first in ((BEFORE, 0), (SKIP, CONTEXTS)):
                code = rows.column(("before", "skip")[way]).to_numpy()
                i = np.flatnonzero(code >= 0)
                side, kind = first + code[i] // CLASSES, code[i] % CLASSES
                events.append((way, i, side, kind))
                taught = learn[i]
                np.add.at(cells, (at[i][taught], way * CLASSES + kind[taught]), 1)
                np.add.at(cells, (at[i][taught], 2 * CLASSES + side[taught]), 1)
            hashed = np.array([ending(w) for w in words], np.int64)
            weights, rooms = fit_words(cells, CONTEXT_OWN + hashed % CONTEXT_ENDINGS, probs)
            part = np.zeros(len(at))
            for way, i, side, kind in events:
                part[i] += weights[at[i], way, kind] - rooms[at[i], side]
            c = np.bincount(at, learn, len(words))[at]
            yield pa.RecordBatch.from_arrays(
                [rows.column("row").chunk(0), pa.array((c > 0).astype(np.int64)),
                 pa.array(np.log10(c + 1)), pa.array(part / np.log(10))],
                ["row", "known", "mass", "part"])

    judged = rare.repartition("word").sortWithinPartitions("word").mapInArrow(
        run, "row long, known long, mass double, part double")
    return judged.groupBy("row").agg(
        F.sum("known").alias("more_known"), F.sum("mass").alias("more_mass"),
        F.sum("part").alias("more_part"))


def score_texts(docs: DataFrame, learn: Column) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Texts for which ``learn`` holds are learned from. A null or empty text is the end token
    alone. ``base_score`` is the add-one unigram probability of the tokens, ``score`` the
    model's, both as log10; words never learned have one shared probability in each class,
    so probabilities of classes, known words and the unknown sum to one. Repeated rows are
    learned from and scored each; other columns are not read. With nothing to learn from,
    all words are unknown and all classes equal.
    """
    spark = docs.sparkSession
    training = docs.filter(learn)
    counts = settle(count_tokens(docs, learn), "token-counts")
    n, v = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    n = n or 0
    head = head_words(counts)
    totals = class_totals(counts, head)
    cells = settle(count_cells(training, head), "cells")
    events = settle(cells.filter("kind is not null").repartition("history"), "events")
    natural = class_logs(train(events), np.arange(CONTEXTS * CONTEXTS))
    weights, rooms = fit_head(cells, head, natural)

    base_room = np.log10(n + v + 1)
    class_room = np.log10(totals[0] + totals[1] + 1)
    shared = spark.sparkContext.broadcast((head, natural / np.log(10), class_room, weights, rooms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, logs, class_room, weights, rooms = shared.value
        own = np.log10(head.count + 1)
        for batch in text_blocks(batches):
            texts = [tokens(t) for t in batch.column("text").to_pylist()]
            lengths = np.array([len(t) for t in texts])
            starts = np.cumsum(lengths) - lengths
            words = [w for t in texts for w in t]
            place, kind, context = head.look_up(words)
            history = histories(context, starts)
            part = logs[history, kind] - class_room[kind]
            back, side = keys(history)
            at = np.flatnonzero(back)
            key = place[at - back[at]]
            at, key = at[key >= 0], key[key >= 0]
            part[at] += (weights[key, back[at] - 1, kind[at]] - rooms[key, side[at]]) / np.log(10)
            found = place >= 0
            mass = np.where(found, own[place], 0.0)
            known = found & (head.count[place] > 0)
            size, row = len(texts), batch.column("row").to_numpy()
            yield pa.RecordBatch.from_arrays([
                pa.array(row), batch.column("doc_id"), pa.array(lengths, pa.int64()),
                pa.array(np.add.reduceat(known, starts, dtype=np.int64)),
                pa.array(np.add.reduceat(mass, starts)), pa.array(np.add.reduceat(part, starts)),
                pa.nulls(size, pa.binary()), pa.nulls(size, pa.bool_()),
                pa.nulls(size, pa.int32()), pa.nulls(size, pa.int32())], NAMES)
            rare = np.flatnonzero(~found)
            if not len(rare):
                continue
            # A text ends with a token of the head, so one token follows in any case.
            of = np.searchsorted(starts, rare, "right") - 1
            before = side[rare + 1] * CLASSES + kind[rare + 1]
            next_but_one = np.minimum(rare + 2, len(words) - 1)
            skip = np.where(back[next_but_one] == 2, (side[next_but_one] - CONTEXTS) * CLASSES
                            + kind[next_but_one], -1)
            none = pa.nulls(len(rare), pa.float64())
            yield pa.RecordBatch.from_arrays([
                pa.array(row[of]), pa.nulls(len(rare), batch.schema.field("doc_id").type),
                none.cast(pa.int64()), none.cast(pa.int64()), none, none,
                pa.array([words[i] for i in rare.tolist()], pa.binary()),
                batch.column("learn").take(pa.array(of)),
                pa.array(before.astype(np.int32)), pa.array(skip.astype(np.int32))], NAMES)

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text", learned_from(learn)
    ).mapInArrow(
        run, f"row long, doc_id {kind}, n_tokens long, n_known long, mass double, part double, "
             "word binary, learn boolean, before int, skip int")
    scored = settle(scored, "scored")
    rest = judge_rare(scored.filter("word is not null").select(
        "row", "word", "learn", "before", "skip"), natural)
    mass = F.col("mass") + F.coalesce("more_mass", F.lit(0.0))
    return (
        scored.filter("word is null").join(rest, "row", "left")
        .select("doc_id", "n_tokens",
                (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                F.lit(n).cast("long").alias("train_tokens"),
                (mass - F.col("n_tokens") * F.lit(float(base_room))).alias("base_score"),
                (mass + F.col("part") + F.coalesce("more_part", F.lit(0.0))).alias("score"))
    )


NAMES = ["row", "doc_id", "n_tokens", "n_known", "mass", "part", "word", "learn", "before", "skip"]
