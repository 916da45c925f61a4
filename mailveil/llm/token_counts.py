"""Token counts by a transducer that emits counts instead of tokens.

The vocabulary is compiled to a transducer that reads characters and emits changes of the
count (see merges). A text is cut into
chunks anywhere. Each chunk gives a state map, maps compose associatively, and a parallel
prefix scan over the chunks gives the count at the end of each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import text_blocks
from .merges import Machine, State

SPACE = "▁"  # fixed value: what the vocabulary writes for a space
RUN = 16  # fixed value: the longest token of spaces alone

CHUNK = 8192
# Counted words are forgotten and begun anew beyond this number.
MAX_WORDS = 500_000

UNIT = re.compile(" +[^ ]*")
SYNC = re.compile("[^ ](?= )")


def spaces(n: int) -> int:
    """Tokens of n spaces that join no word; no token has one space less than the longest."""
    return -(-n // RUN) + (n % RUN == RUN - 1)


class Open(NamedTuple):
    """A unit that may go on: its spaces, the state behind the last of them and what followed,
    the tokens of that, and whether a character has followed."""

    run: int
    state: State
    tokens: int
    word: bool


class ChunkMap(NamedTuple):
    """What a chunk does to any state before it: the state first reads ``head``; if there is
    an ``end``, the unit then closes, ``done`` further tokens are complete and ``end`` is
    open, whatever the state was."""

    head: str
    done: int
    end: Open | None


class Counter:
    """Counts the tokens of texts for one vocabulary."""

    def __init__(self, pieces: dict[str, int]):
        self.machine = Machine(pieces, marked=SPACE)
        state, _ = self.machine.step(self.machine.start, SPACE)
        self.fresh = state
        self.units: dict[str, int] = {}

    def feed(self, at: Open, text: str) -> tuple[int, Open]:
        """Tokens of the units that close inside the text, and the open one after it."""
        done, (run, state, tokens, word) = 0, at
        step = self.machine.step
        for char in text:
            if char != " ":
                state, change = step(state, char)
                tokens, word = tokens + change, True
            elif word:
                done += self.close(Open(run, state, tokens, word))
                run, state, tokens, word = 1, self.fresh, 1, False
            else:
                run += 1
        return done, Open(run, state, tokens, word)

    def close(self, at: Open) -> int:
        """Tokens of a unit: a first token that is a space alone joins the run before it."""
        if at.state.entries[-1][-1]:
            return spaces(at.run) + at.tokens - 1
        return spaces(at.run - 1) + at.tokens

    def unit(self, text: str) -> int:
        known = self.units.get(text)
        if known is None:
            if len(self.units) >= MAX_WORDS:
                self.units.clear()
            run = len(text) - len(text.lstrip(" "))
            done, rest = self.feed(Open(run, self.fresh, 1, False), text[run:])
            known = done + self.close(rest)
            if len(text) < 64:
                self.units[text] = known
        return known

    def map_chunk(self, text: str) -> ChunkMap:
        first = SYNC.search(text)
        if first is None:
            return ChunkMap(text, 0, None)
        units = UNIT.findall(text, first.end())
        last = units.pop()
        run = len(last) - len(last.lstrip(" "))
        _, end = self.feed(Open(run, self.fresh, 1, False), last[run:])
        known = self.units
        try:
            done = sum([known[u] for u in units])
        except KeyError:
            done = sum([self.unit(u) for u in units])
        return ChunkMap(text[:first.end()], done, end)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.end is None:
            return ChunkMap(a.head + b.head, b.done, b.end)
        done, at = self.feed(a.end, b.head)
        if b.end is None:
            return ChunkMap(a.head, a.done + done, at)
        return ChunkMap(a.head, a.done + done + self.close(at) + b.done, b.end)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """Inclusive prefix scan: pairs are composed, their scan is taken, and every other
        prefix follows from it by one more composition."""
        if len(maps) < 2:
            return maps
        pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])]
        scanned = self.scan(pairs)
        out = [maps[0]]
        for i in range(1, len(maps)):
            out.append(scanned[i // 2] if i % 2 else self.compose(scanned[i // 2 - 1], maps[i]))
        return out

    def prefix_counts(self, text: str, chunk: int = CHUNK) -> list[int]:
        """Tokens of the text up to the end of each chunk."""
        if not text:
            return [0]
        text = " " + text.replace(SPACE, " ")
        maps = [self.map_chunk(text[i:i + chunk]) for i in range(0, len(text), chunk)]
        return [self.total(m) for m in self.scan(maps)]

    def total(self, m: ChunkMap) -> int:
        """Tokens of a text that the map stands for as a whole; it begins with a space."""
        run = len(m.head) - len(m.head.lstrip(" "))
        done, at = self.feed(Open(run, self.fresh, 1, False), m.head[run:])
        done += self.close(at)
        return done if m.end is None else done + m.done + self.close(m.end)

    def count(self, text: str) -> int:
        return self.prefix_counts(text)[-1]


@cache
def counter(path: str) -> Counter:
    """The counter of a vocabulary file, once per worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        special = model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
        if not special and (piece == SPACE or SPACE not in piece[1:]):
            pieces[piece] = (-model.get_score(i), i)
    order = sorted(pieces, key=pieces.get)
    return Counter({piece: rank for rank, piece in enumerate(order)})


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    A null text is empty and has no tokens. Every row of the table gives a row, repeated ones
    and those with a null id too; other columns are not read. Texts of any length are counted
    whole, chunk by chunk. Nothing is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in text_blocks(batches):
            texts = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            counts = [count(t) if t else 0 for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes, pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array([n > limit for n in counts], pa.bool_()),
            ], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
