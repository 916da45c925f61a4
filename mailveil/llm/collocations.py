"""Phrase collocations: counts in a burst trie per task, merged runs, cuts scored exactly.

A phrase counts only if it occurs often, and then so do all its parts. So words are counted
first, then pairs of frequent words by their hash, then pairs with a frequent hash and phrases
of three and four words of such pairs by their words. Which hashes are frequent reaches the
tasks as bit tables of a fixed size: a false yes costs a count, a false no cannot happen.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import text_blocks

LONGEST = 4
LEAST_COUNT = 30
BEST = 2000
# The best of a language are chosen among the best of so many hashed parts of its phrases, which
# bounds what meets in one task to RANK_PARTS * BEST rows.
RANK_PARTS = 16
# A candidate inside a longer one that has this share of its count, in percent, goes.
COVERED = 80
SCORE_UNIT = 2_000_000

# Bits of the tables of frequent words and pairs: 4 MB each, whatever the corpus. More bits
# let fewer rare pairs through on a larger one.
TABLE_BITS = 25

# Bytes of text whose phrases are found at a time.
BLOCK = 4 << 20
# Phrases in a container before it bursts, and in a trie before subtrees are spilled.
BURST = 1 << 14
HELD = 1 << 20
# Words that a task knows, and their bytes, before it forgets the rare ones or, if that does
# not help, spills all and starts again.
WORDS, WORD_BYTES = 1 << 18, 32 << 20
# Frequent pairs that a task numbers before it does so.
PAIRS = 1 << 19
# Phrases that are spelled out at a time.
SPELLED = 1 << 13

# Bytes of the text as the splitting needs them: A-Z lower, a tab as a space, and at the end
# of a piece 0xFF, which no UTF-8 text contains.
END = b"\xff"
SPLIT = bytes(
    0x20 if b == 0x09 else 0xFF if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b
    for b in range(256))
GONE = -1
FREE = np.uint64(0xFFFFFFFFFFFFFFFF)
LOW = np.uint64(0xFFFFFFFF)


def split_words(texts: list[bytes]) -> pa.DictionaryArray:
    """The words of some texts, with END after each piece and between two texts."""
    joined = (b" " + END).join([t.translate(SPLIT) for t in texts]).replace(END, b" " + END + b" ")
    data = np.frombuffer(joined, np.uint8)
    letter = data != 0x20
    edges = np.diff(np.concatenate(([False], letter, [False])).astype(np.int8))
    lengths = np.flatnonzero(edges == -1) - np.flatnonzero(edges == 1)
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(lengths), [
        None, pa.py_buffer(offsets), pa.py_buffer(data[letter])])
    return words.dictionary_encode()


def scatter(keys: np.ndarray) -> np.ndarray:
    """Keys as well-mixed 64-bit numbers."""
    keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return keys ^ (keys >> np.uint64(29))


def lang_seed(lang: str) -> int:
    return xxhash.xxh32_intdigest(lang.encode())


def word_hash(seed: int, word: bytes) -> int:
    """What stands for a word of a language in the bit tables, in every task."""
    return xxhash.xxh64_intdigest(word, seed)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return scatter(first * np.uint64(3) + scatter(second))


class Container:
    """A hash table from keys to counts, in arrays: open addressing, at most half full."""

    def __init__(self, low: int = 0, slots: int = 64):
        self.low, self.n = low, 0
        self.keys, self.counts = np.full(slots, FREE), np.zeros(slots, np.int64)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        used = self.keys != FREE
        return self.keys[used], self.counts[used]

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add counts; no key stands twice in ``keys``."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old = self.entries()
            slots = 1 << int(2 * (self.n + len(keys))).bit_length()
            self.n, self.keys, self.counts = 0, np.full(slots, FREE), np.zeros(slots, np.int64)
            self._put(*old)
        self._put(keys, counts)

    def _put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        last = np.uint64(len(self.keys) - 1)
        at = scatter(keys) & last
        while len(keys):
            free = self.keys[at] == FREE
            # Of keys that find the same free slot one gets it; the others see it taken.
            self.keys[at[free]] = keys[free]
            here = self.keys[at] == keys
            self.counts[at[here]] += counts[here]
            self.n += int((free & here).sum())
            keys, counts, at = keys[~here], counts[~here], (at[~here] + np.uint64(1)) & last


class BurstTrie:
    """Counts of phrases, given as keys of two numbers: the beginning high, the rest low.

    Few containers hold the phrases of ranges of beginnings. One that grows too large bursts
    into two at a beginning near its middle, or, if it has a single beginning, at a rest, a
    level deeper. When the whole holds too much, the largest subtrees leave as sorted runs.
    """

    def __init__(self, burst: int = BURST, held: int = HELD):
        self.burst, self.held = burst, held
        self.containers = [Container()]

    def __len__(self) -> int:
        return sum(c.n for c in self.containers)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add counts of distinct, ascending keys."""
        lows = np.array([c.low for c in self.containers], np.uint64)
        ends = np.append(np.searchsorted(keys, lows[1:]), len(keys))
        grown, start = [], 0
        for container, end in zip(self.containers, ends):
            if end > start:
                container.add(keys[start:end], counts[start:end])
            grown.extend(self._parts(container))
            start = end
        self.containers = grown

    def _parts(self, container: Container) -> Iterator[Container]:
        if container.n <= self.burst:
            yield container
            return
        keys, counts = container.entries()
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        middle = len(keys) // 2
        beginning = keys[middle] >> np.uint64(32) << np.uint64(32)
        cut = int(np.searchsorted(keys, beginning))
        if not cut:
            cut = int(np.searchsorted(keys, beginning + np.uint64(1 << 32)))
        if cut == len(keys):
            beginning, cut = keys[middle], middle
        else:
            beginning = keys[cut] >> np.uint64(32) << np.uint64(32)
        for low, part in ((container.low, slice(0, cut)), (int(beginning), slice(cut, None))):
            child = Container(low)
            child.add(keys[part], counts[part])
            yield from self._parts(child)

    def spill(self, keep: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Empty the largest containers until at most ``keep`` phrases are held; each leaves
        as a run, sorted by key."""
        held = len(self)
        for container in sorted(self.containers, key=lambda c: -c.n):
            if held <= keep:
                break
            if container.n:
                held -= container.n
                keys, counts = container.entries()
                order = np.argsort(keys)
                container.__init__(container.low)
                yield keys[order], counts[order]
        if not keep:
            self.containers = [Container()]

    def overflow(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(self) > self.held:
            yield from self.spill(self.held // 2)


class Words(dict):
    """Numbers of the words of one language; GONE for words that cannot be frequent."""

    def __init__(self, lang: str, shared: "Lexicon"):
        super().__init__({END: GONE})
        self.lang, self.seed, self.shared = lang, lang_seed(lang), shared

    def __missing__(self, word: bytes) -> int:
        shared, code = self.shared, word_hash(self.seed, word)
        shared.held += 1
        shared.bytes += len(word)
        bit = code >> (64 - TABLE_BITS)
        if shared.bits is not None and not shared.bits[bit >> 3] >> (bit & 7) & 1:
            self[word] = GONE
            return GONE
        self[word] = number = len(shared.words)
        shared.words.append(word)
        shared.of_lang.append(self.lang)
        shared.hashes.append(code)
        return number


class Lexicon:
    """Words a task has met, in all languages. ``frequent`` is a bit table or None for all."""

    def __init__(self, frequent: np.ndarray | None):
        self.bits = None if frequent is None else memoryview(frequent.view(np.uint8))
        self.langs: dict[str, Words] = {}
        self.words: list[bytes] = []
        self.of_lang: list[str] = []
        self.hashes = array("Q")
        self.held = self.bytes = 0

    def crowded(self) -> bool:
        """Too many words are held, also after forgetting those without a number."""
        if self.held <= WORDS and self.bytes <= WORD_BYTES:
            return False
        self.held = self.bytes = 0
        for lang, known in self.langs.items():
            kept = self.langs[lang] = Words(lang, self)
            kept.update((w, number) for w, number in known.items() if number != GONE)
            self.held += len(kept)
            self.bytes += sum(map(len, kept))
        return self.held > WORDS // 2 or self.bytes > WORD_BYTES // 2

    def numbers(self, lang: str, texts: list[bytes]) -> np.ndarray:
        """Numbers of all words of some texts, GONE between pieces and after the last."""
        known = self.langs.get(lang)
        if known is None:
            known = self.langs[lang] = Words(lang, self)
        words = split_words(texts)
        of_word = np.array([known[w] for w in words.dictionary.to_pylist()] + [GONE], np.int64)
        return np.append(of_word[words.indices.to_numpy()], GONE)

    def word_hashes(self) -> np.ndarray:
        return np.array(self.hashes, np.uint64)


def has(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Whether the bits of the codes are set."""
    bit = codes >> np.uint64(64 - TABLE_BITS)
    return (table[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def bit_table(codes: DataFrame) -> np.ndarray:
    """The bit table of a column ``code``.

    The bits are joined on Spark; what reaches the driver are at most 2 ** TABLE_BITS / 64
    words, however many codes there are.
    """
    bit = F.shiftrightunsigned("code", 64 - TABLE_BITS)
    rows = codes.select(
        F.shiftright(bit, 6).alias("at"),
        F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
        .alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    table[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return table


def text_numbers(lexicon: Lexicon, batch: pa.RecordBatch) -> np.ndarray:
    """Numbers of all words of a batch, GONE between pieces and texts."""
    by_lang: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        by_lang.setdefault(lang, []).append(text)
    return np.concatenate([lexicon.numbers(lang, texts) for lang, texts in by_lang.items()])


def joined_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)


def pairs_of(words: np.ndarray) -> np.ndarray:
    """Places at which a pair of known words begins."""
    return np.flatnonzero((words[:-1] >= 0) & (words[1:] >= 0))


class Counter:
    """Tries by kind of phrase, and the words that their keys stand for."""

    def __init__(self, lexicon: Lexicon, *kinds: str):
        self.lexicon, self.tries = lexicon, {kind: BurstTrie() for kind in kinds}

    def crowded(self) -> bool:
        return self.lexicon.crowded()

    def runs(self, spill) -> Iterator[pa.RecordBatch]:
        """What the tries spill, spelled out."""
        words = langs = None
        for kind, trie in self.tries.items():
            for keys, counts in spill(trie):
                if words is None:
                    words = pa.array(self.lexicon.words, pa.binary()).cast(pa.string())
                    langs = pa.array(self.lexicon.of_lang, pa.string())
                for i in range(0, len(keys), SPELLED):
                    numbers = self.phrase(kind, keys[i:i + SPELLED])
                    parts = [words.take(pa.array(n)) for n in numbers]
                    phrase = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(
                        *parts, " ")
                    yield pa.RecordBatch.from_arrays(
                        [langs.take(pa.array(numbers[0])), phrase,
                         pa.array(counts[i:i + SPELLED])], ["lang", "phrase", "f"])


class WordCounter(Counter):
    """Counts the words themselves."""

    def __init__(self, lexicon: Lexicon):
        super().__init__(lexicon, "words")

    def count(self, words: np.ndarray) -> None:
        found, counts = np.unique(words[words >= 0], return_counts=True)
        self.tries["words"].add(joined_keys(found, found * 0), counts)

    def phrase(self, kind: str, keys: np.ndarray) -> list[np.ndarray]:
        return [keys >> np.uint64(32)]


class PairCounter(Counter):
    """Counts pairs of frequent words; they leave as hashes."""

    def __init__(self, lexicon: Lexicon):
        super().__init__(lexicon, "pairs")

    def count(self, words: np.ndarray) -> None:
        at = pairs_of(words)
        self.tries["pairs"].add(*np.unique(
            joined_keys(words[at], words[at + 1]), return_counts=True))

    def runs(self, spill) -> Iterator[pa.RecordBatch]:
        hashes = self.lexicon.word_hashes()
        for keys, counts in spill(self.tries["pairs"]):
            codes = pair_hash(hashes[keys >> np.uint64(32)], hashes[keys & LOW])
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes.view(np.int64)), pa.array(counts)], ["code", "f"])


class LongCounter(Counter):
    """Counts frequent pairs, and phrases of three and four words whose pairs are all frequent.

    Frequent pairs get numbers of their own, so the trie's keys stay two numbers: a pair and
    a word, or two pairs.
    """

    def __init__(self, lexicon: Lexicon, frequent: np.ndarray):
        super().__init__(lexicon, "pairs", "threes", "fours")
        self.frequent = frequent
        self.pairs, self.numbers = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.by_number = self.pairs

    def crowded(self) -> bool:
        return self.lexicon.crowded() or len(self.pairs) > PAIRS

    def numbered(self, pairs: np.ndarray) -> np.ndarray:
        """Numbers of distinct ascending pairs; new ones are added."""
        at = np.searchsorted(self.pairs, pairs)
        known = np.zeros(len(pairs), bool)
        inside = at < len(self.pairs)
        known[inside] = self.pairs[at[inside]] == pairs[inside]
        new = pairs[~known]
        if len(new):
            merged = np.concatenate((self.pairs, new))
            numbers = np.concatenate((self.numbers, len(self.pairs) + np.arange(len(new))))
            order = np.argsort(merged, kind="stable")
            self.pairs, self.numbers = merged[order], numbers[order]
            self.by_number = np.concatenate((self.by_number, new))
            at = np.searchsorted(self.pairs, pairs)
        return self.numbers[at]

    def count(self, words: np.ndarray) -> None:
        hashes, at = self.lexicon.word_hashes(), pairs_of(words)
        pairs, of, counts = np.unique(
            joined_keys(words[at], words[at + 1]), return_inverse=True, return_counts=True)
        often = has(self.frequent, pair_hash(hashes[pairs >> np.uint64(32)], hashes[pairs & LOW]))
        self.tries["pairs"].add(pairs[often], counts[often])
        number = np.full(len(pairs), GONE, np.int64)
        number[often] = self.numbered(pairs[often])
        # The number of the pair that begins at each place.
        pair = np.full(len(words) + 2, GONE, np.int64)
        pair[at] = number[of]
        three = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0))
        four = three[pair[three + 2] >= 0]
        self.tries["threes"].add(*np.unique(
            joined_keys(pair[three], words[three + 2]), return_counts=True))
        self.tries["fours"].add(*np.unique(
            joined_keys(pair[four], pair[four + 2]), return_counts=True))

    def phrase(self, kind: str, keys: np.ndarray) -> list[np.ndarray]:
        first, last = keys >> np.uint64(32), keys & LOW
        if kind == "pairs":
            return [first, last]
        first = self.by_number[first]
        if kind == "threes":
            return [first >> np.uint64(32), first & LOW, last]
        last = self.by_number[last]
        return [first >> np.uint64(32), first & LOW, last >> np.uint64(32), last & LOW]


def count_phrases(docs: DataFrame, make, key: str) -> DataFrame:
    """``key`` and ``f``: counts over all documents.

    Each task counts in tries of bounded size and gives away what exceeds them as runs. Runs
    meet by the hash of the whole phrase: any shorter prefix of a phrase can be so common that
    its subtrees would be one task's work.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = make()
        for batch in text_blocks(batches, BLOCK):
            counter.count(text_numbers(counter.lexicon, batch))
            yield from counter.runs(BurstTrie.overflow)
            if counter.crowded():
                yield from counter.runs(BurstTrie.spill)
                counter = make()
        yield from counter.runs(BurstTrie.spill)

    runs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"),
                       F.coalesce("text", F.lit("")).cast("binary").alias("text")
                       ).mapInArrow(run, f"{key}, f long")
    names = [part.split()[0] for part in key.split(", ")]
    return runs.groupBy(*names).agg(F.sum("f").alias("f"))


def word_codes(words: DataFrame) -> DataFrame:
    """The codes of words for the bit table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [word_hash(lang_seed(lang), word.encode()) for lang, word in zip(
                batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(codes, np.uint64).view(np.int64))], ["code"])

    return words.select("lang", "phrase").mapInArrow(run, "code long")


def phrase_counts(docs: DataFrame, least: int = LEAST_COUNT) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, f)`` of all phrases of one to LONGEST words with ``f >= least``, and
    ``(lang, n)``, the words of each language; both are written tables."""
    context = docs.sparkSession.sparkContext
    often, phrase = F.col("f") >= least, "lang string, phrase string"
    words = settle(count_phrases(docs, lambda: WordCounter(Lexicon(None)), phrase), "word-counts")
    totals = settle(words.groupBy("lang").agg(F.sum("f").alias("n")), "word-totals")
    known = context.broadcast(bit_table(word_codes(words.filter(often))))
    codes = count_phrases(docs, lambda: PairCounter(Lexicon(known.value)), "code long")
    common = context.broadcast(bit_table(settle(codes.filter(often), "pair-codes")))
    longer = settle(
        count_phrases(docs, lambda: LongCounter(Lexicon(known.value), common.value), phrase)
        .filter(often), "phrase-counts")
    return words.filter(often).unionByName(longer), totals


def scored(counts: DataFrame) -> DataFrame:
    """``(lang, phrase, a, l, r, score, words)``: phrases of two words and more, cut where the
    score is lowest, at the first such place.

    Both parts of a cut occur at least as often as the phrase, so they are in ``counts``.
    """
    cuts = (
        counts.select("lang", "phrase", F.col("f").alias("a"),
                      F.split("phrase", " ", -1).alias("w"))
        .filter(F.size("w") > 1)
        .select("lang", "phrase", "a", F.size("w").alias("words"), "w",
                F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
        .select("lang", "phrase", "a", "words", "k",
                F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"),
                F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right")))
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    # Whole numbers of 38 digits: the product may pass 64 bits.
    product = F.col("a").cast("decimal(25,0)") * F.lit(SCORE_UNIT).cast("decimal(9,0)")
    score = F.call_function("div", product, F.col("l").cast("decimal(25,0)") + F.col("r"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return (
        cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
        .withColumn("score", score.cast("long"))
        .groupBy("lang", "phrase", "a", "words").agg(lowest)
        .select("lang", "phrase", "a", "words", "cut.l", "cut.r", "cut.score"))


def covered(candidates: DataFrame) -> DataFrame:
    """``(lang, phrase, most)``: phrases that stand inside longer candidates, and the largest
    count of one."""
    w = F.split("phrase", " ", -1)
    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("words") - 1),
        lambda n: F.transform(
            F.sequence(F.lit(1), F.col("words") - n + 1),
            lambda i: F.array_join(F.slice(F.col("w"), i, n), " "))))
    return (
        candidates.filter("words > 2").withColumn("w", w)
        .select("lang", F.explode(inner).alias("phrase"), "a")
        .groupBy("lang", "phrase").agg(F.max("a").alias("most")))


def collocations(docs: DataFrame, least: int = LEAST_COUNT, best: int = BEST,
                 share: int = COVERED) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A null language is ``und``, a null text empty; texts without words add nothing, repeated
    rows count as often as they stand there, and no id is read. An empty table gives no rows.
    Equal scores and counts go by the bytes of the phrase. Exact at any size: the tables of
    bits only save work.
    """
    counts, totals = phrase_counts(docs, least)
    candidates = settle(scored(counts), "phrases")
    kept = (
        candidates.join(covered(candidates), ["lang", "phrase"], "left")
        .filter(F.col("most").isNull() | (
            F.col("most").cast("decimal(25,0)") * F.lit(100)
            < F.col("a").cast("decimal(25,0)") * F.lit(share))))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    within = Window.partitionBy("lang", "_part").orderBy(*order)
    return (
        kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
        .withColumn("_place", F.row_number().over(within)).filter(F.col("_place") <= best)
        .withColumn("rank", F.row_number().over(
            Window.partitionBy("lang").orderBy(*order)).cast("long"))
        .filter(F.col("rank") <= best)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
