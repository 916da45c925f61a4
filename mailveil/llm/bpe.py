"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a piece of text the one valid last token is stored. Appending bytes goes
on where the table ends, and an edit is encoded again only from its place to where the
stored tokens agree with the old ones.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import text_blocks, with_columns
from .merges import Machine

# Bytes of text whose ids are held at a time.
ENCODED_AT_ONCE = 2 << 20
# Encoded pieces of text are forgotten and begun anew beyond this number.
MAX_PIECES = 500_000


class Vocabulary:
    """Ranks of byte strings. Bytes are handled as characters of the same number, so that
    tokens are ordinary strings."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        if any(chr(b) not in self.ranks for b in range(256)):
            raise ValueError("each byte must be a token")
        self.machine = Machine(self.ranks, counted=False)
        self.bytes = {str(rank): token for token, rank in ranks.items()}


class PrefixTable:
    """One piece of text, with the state of each of its prefixes, which holds the prefix's
    last token."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.text, self.states = vocabulary, "", []
        self.append(data)

    def append(self, data: bytes) -> None:
        machine, new = self.vocabulary.machine, data.decode("latin-1")
        state = self.states[-1] if self.states else machine.start
        self.text += new
        for char in new:
            state, _ = machine.step(state, char)
            self.states.append(state)

    def edit(self, start: int, stop: int, data: bytes) -> int:
        """Replace the bytes from start to stop; the number of prefixes worked out again.

        The same rest of the text goes on alike from the same state, so the old states hold
        again from the first that the new ones meet.
        """
        old, tail = self.states[stop:], self.text[stop:]
        del self.states[start:]
        self.text = self.text[:start]
        self.append(data)
        machine, at = self.vocabulary.machine, 0
        state = self.states[-1] if self.states else machine.start
        while at < len(tail):
            state, _ = machine.step(state, tail[at])
            if state.entries == old[at].entries:
                break
            self.states.append(state)
            at += 1
        self.states.extend(old[at:])
        self.text += tail
        return len(data) + at

    def tokens(self) -> list[str]:
        out, end = [], len(self.text)
        while end:
            out.append(self.states[end - 1].token)
            end -= len(out[-1])
        return out[::-1]

    def ids(self) -> list[int]:
        return [self.vocabulary.ranks[t] for t in self.tokens()]


class Coder(dict):
    """Encodes and decodes whole texts. Maps a piece of text to its ids in decimal, one space
    between them."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        super().__init__()
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)

    def __missing__(self, piece: str) -> str:
        table = PrefixTable(self.vocabulary, piece.encode())
        found = " ".join(map(str, table.ids()))
        if len(piece) < 64:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = found
        return found

    def line(self, text: str) -> str:
        """Ids in decimal, a space between. The pattern must cover the text; each match is
        encoded alone."""
        return " ".join([self[m] for m in self.pattern.findall(text)])

    def encode(self, text: str) -> list[str]:
        return self.line(text).split()

    def decode(self, ids: list[str]) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids))


@cache
def coder(path: str, pattern: str) -> Coder:
    """The coder of a file of ranks, once per worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return Coder(Vocabulary(ranks), pattern)


def encode(docs: DataFrame, path: str, pattern: str, ids: bool = True,
           digests: bool = False) -> DataFrame:
    """The documents with ``n_tokens`` and, as asked, ``ids`` and digests of ids and text.

    ``ids_sha256`` is of the ids in decimal with a space between them, ``decoded_sha256`` of
    the bytes that decoding the ids gives. A null text is empty and has no ids. All rows are
    encoded whole, repeated ones too, and keep their other columns; a column with the name
    of a new one is replaced. Nothing is shuffled.
    """
    new = {"n_tokens": "long"} | ({"ids": "array<int>"} if ids else {}) | (
        {"ids_sha256": "string", "decoded_sha256": "string"} if digests else {})
    kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()),
             "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    kept = [c for c in docs.columns if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for batch in text_blocks(batches, ENCODED_AT_ONCE):
            made = {name: [] for name in new}
            for text in batch.column("text"):  # one at a time: ids take more room than text
                line = code.line(text.as_py() or "")
                numbers = line.split()
                made["n_tokens"].append(len(numbers))
                if ids:
                    made["ids"].append(np.array(numbers, np.int32))
                if digests:
                    made["ids_sha256"].append(sha256(line.encode()).hexdigest())
                    made["decoded_sha256"].append(sha256(code.decode(numbers)).hexdigest())
            made = {name: pa.array(values, kinds[name]) for name, values in made.items()}
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + list(made.values()), kept + list(made))

    schema = with_columns(docs.select(kept), ", ".join(f"{n} {k}" for n, k in new.items()))
    return docs.select(kept).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Add ``decoded``, the bytes of ``ids``. Null ids decode to null."""
    schema = with_columns(encoded, "decoded binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for batch in batches:
            decoded = [None if r is None else code.decode(list(map(str, r)))
                       for r in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
