"""Language identification by compression: a text belongs to the language whose dictionary
makes it smallest."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_blocks, with_columns

UNKNOWN = "und"

# The bounded sample that the dictionaries are cut from. Of each language the labelled
# documents with the smallest hashed ids give a stretch of so many characters, from a hashed
# place anywhere in the text. All stretches share the bytes of a dictionary: each has an equal
# part, and what short ones leave goes to the others.
SAMPLE_DOCUMENTS = 256
STRETCH = 2048
DICTIONARY_BYTES = 96 << 10
# The languages with most documents are told apart, so many at most, of equally frequent ones
# the first by name; others teach nothing and are never predicted. Bounds what reaches the
# driver: LANGUAGES * SAMPLE_DOCUMENTS * STRETCH characters.
LANGUAGES = 1000

# Compression level, and the one for a second look at texts whose margin is narrow; matches
# of few bytes count, since words are short.
LEVEL, FINE_LEVEL = 5, 19
MIN_MATCH = {LEVEL: 4, FINE_LEVEL: 3}
# A text is compressed in blocks, since in a long one its own words soon help more than the
# dictionary does.
BLOCK = 4096

# Before a short text, lets the compressor save something: it stores as it is what it cannot
# make smaller, and that is as long with any dictionary.
PADDING = b" " * 256

# The best language must save this part of what the second best needs.
MIN_MARGIN = 0.002
# Probability that a saved byte stands for, as a base: each makes the language so much likelier.
BYTE_ODDS = 1.5

NO_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str | None) -> bytes:
    """Lower-case letters (Unicode category L), one space for anything between them."""
    words = NO_LETTERS.sub(" ", (text or "").lower()).strip()
    if not words.replace(" ", "").isalpha():
        # \w also takes numbers that are no digits: superscripts, fractions, Roman numerals.
        words = " ".join("".join(c if c.isalpha() else " " for c in words).split())
    return words.encode()


def sample_dictionaries(labelled: DataFrame) -> list[tuple[str, bytes]]:
    """A raw dictionary per language, the language with most documents first.

    ``labelled`` has doc_id, text, lang; rows without id, text or language teach nothing. Ids
    are chosen, not rows: of rows that repeat an id one stretch counts, the smallest.
    """
    known = labelled.filter(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "lang").limit(LANGUAGES)
    names = [row.lang for row in counts.collect()]
    order = Window.partitionBy("lang").orderBy("turn", "doc_id")
    chosen = (
        known.filter(F.col("lang").isin(names)).select("lang", "doc_id").distinct()
        .withColumn("turn", F.xxhash64("doc_id"))
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= SAMPLE_DOCUMENTS).select("lang", "doc_id", "place")
    )
    spare = F.greatest(F.length("text") - STRETCH, F.lit(0)) + 1
    start = F.pmod(F.xxhash64("doc_id", F.lit("stretch")), spare).cast("int") + 1
    # At most SAMPLE_DOCUMENTS ids per language, and after the minimum one row for each.
    texts = (
        known.join(F.broadcast(chosen), ["lang", "doc_id"])
        .select("lang", "place", F.substr("text", start, F.lit(STRETCH)).alias("text"))
        .groupBy("lang", "place").agg(F.min("text").alias("text")).collect()
    )
    parts: dict[str, list[tuple[int, bytes]]] = {name: [] for name in names}
    for row in texts:
        parts[row.lang].append((row.place, plain(row.text)))
    return build_dictionaries({n: [t for _, t in sorted(held) if t] for n, held in parts.items()})


def shared_out(texts: list[bytes], size: int) -> list[bytes]:
    """The beginnings of the texts that fit into ``size`` together, with one byte between two.

    Each may have an equal part; what a shorter text leaves goes to the longer ones.
    """
    out, left = [], size
    for k, text in enumerate(sorted(texts, key=len)):
        out.append(text[:max(0, left // (len(texts) - k) - 1)])
        left -= len(out[-1]) + 1
    return out


def build_dictionaries(sample: dict[str, list[bytes]]) -> list[tuple[str, bytes]]:
    """A dictionary from the texts of each language, less those that look mislabelled.

    Each half of the sample is judged by dictionaries of the other half; texts that those
    put into another language are left out, unless that would leave none.
    """
    def joined(texts: list[bytes]) -> bytes:
        return b" ".join(shared_out(texts, DICTIONARY_BYTES))

    halves = [{n: texts[k::2] for n, texts in sample.items()} for k in (0, 1)]
    judges = [Classifier([(n, joined(t)) for n, t in h.items() if t]) for h in halves]
    out = []
    for name, texts in sample.items():
        good = [t for i, t in enumerate(texts) if judges[1 - i % 2].name_of(t) in (name, UNKNOWN)]
        if content := joined(good or texts):
            out.append((name, content))
    return out


def compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters.from_level(
        level, source_size=BLOCK, dict_size=len(content), min_match=MIN_MATCH[level],
        write_content_size=False, write_dict_id=False, write_checksum=False)
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=settings)


class Classifier:
    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        self.names = [name for name, _ in dictionaries]
        self.coarse, self.fine = (
            [compressor(content, level) for _, content in dictionaries]
            for level in (LEVEL, FINE_LEVEL))

    @staticmethod
    def sizes(body: bytes, compressors: list[zstandard.ZstdCompressor]) -> list[int]:
        blocks = [body[i:i + BLOCK] for i in range(0, len(body), BLOCK)]
        return [sum([len(c.compress(b)) for b in blocks]) for c in compressors]

    def name_of(self, body: bytes) -> str:
        sizes = self.sizes(body, self.coarse)
        return self.names[sizes.index(min(sizes))] if sizes else UNKNOWN

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """The language, a score from 0 to 1, and the margin over the second best."""
        body = plain(text)
        if not body or not self.names:
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(body, self.coarse)
        if self.margin(sizes) < MIN_MARGIN:
            sizes = self.sizes(PADDING + body, self.fine)
        best = min(sizes)
        odds = sum(math.pow(BYTE_ODDS, -min(s - best, 1000)) for s in sizes)
        return self.names[sizes.index(best)], 1 / odds, self.margin(sizes)

    @staticmethod
    def margin(sizes: list[int]) -> float:
        if len(sizes) == 1:
            return 1.0
        best, second = sorted(sizes)[:2]
        return (second - best) / second


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], kept: list[str | Column],
             min_margin: float = MIN_MARGIN) -> DataFrame:
    """The ``kept`` columns of the documents with lang_pred, score, margin and rejected.

    Only the text is looked at. Without letters (Unicode category L), as in a null or empty text, the language is
    ``und`` and the row is rejected; if no language was learned, all are. Otherwise a row is
    rejected if the best language saves less than ``min_margin`` of the second best's size;
    among equal sizes the language with more training documents is named. Rows are neither
    dropped nor joined, whatever their other columns; kept columns with the names of new ones
    are replaced. Texts are compressed whole.
    """
    new = ["lang_pred", "score", "margin", "rejected"]
    rows = docs.select(*kept, F.col("text").alias("_text"))
    names = [c for c in rows.columns if c not in new and c not in ("text", "_text")]
    whole = "text" in rows.columns  # it need not go to the task and back twice
    if whole:
        rows = rows.drop("text").withColumn("text", F.col("_text")).drop("_text")
        names.append("text")
    body = "text" if whole else "_text"
    schema = with_columns(rows.select(names), "lang_pred string, score double, margin double, "
                                              "rejected boolean")
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(shared.value).classify
        for batch in text_blocks(batches, text=body):
            found = [classify(t) for t in batch.column(body).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                *[batch.column(n) for n in names],
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[2] for f in found], pa.float64()),
                pa.array([f[0] == UNKNOWN or f[2] < min_margin for f in found], pa.bool_()),
            ], [*names, *new])

    return rows.mapInArrow(run, schema)


def drop_unidentified(docs: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The documents whose language is told, with all their columns.

    Learns from the rows with a language outside fold 0 of 5; where there are none, no
    language is known and nothing stays.
    """
    learned = sample_dictionaries(docs.filter(fold(5) != 0))
    new = ("lang_pred", "score", "margin", "rejected")
    clash = {c: f"_own_{c}" for c in docs.columns if c in new}
    rows = docs.withColumnsRenamed(clash)
    return identify(rows, learned, rows.columns, min_margin).filter(~F.col("rejected")).select(
        *[F.col(clash.get(c, c)).alias(c) for c in docs.columns])


def fold(parts: int) -> Column:
    """The fold of a document, from its id alone; a null id counts as the empty one."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(parts))
