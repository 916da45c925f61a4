"""Document quality by hierarchical empirical Bayes.

A classifier turns a text into evidence. The evidence of all documents of a host, and of a
path within it, gives the site's rate of good documents, shrunk toward the level above: a
path with few documents is judged like its host, a host with few like all hosts. A
document's score combines its own evidence with the rate of its site, its own part in that
rate taken out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import hot_join, text_blocks, with_columns

# At most so many labelled documents train the classifier, those with the smallest hashed ids.
SAMPLE = 20_000
RIDGE = 1.0
# Prior counts are kept in these bounds, as moments of few sites say little.
LEAST_PRIOR, MOST_PRIOR = 2.0, 10_000.0
# Evidence is held to these odds: no text alone outweighs any site.
MOST_LOGIT = 12.0

FEATURES = ("log_words", "letters", "upper", "digits", "symbols", "marks", "bars", "distinct",
            "top_word", "word_length", "repeats", "line_length", "grams")
MARK = re.compile(r"[!#$%&*]{2,}")


# Places that words, pairs of neighbours, and beginnings and ends of words are hashed to, and
# the bytes of such an end.
PLACES, ENDING = 1 << 14, 3


def gram_places(text: str | None) -> np.ndarray:
    """The distinct places of a text's n-grams."""
    words = (text or "").lower().encode().split()
    if not words:
        return np.empty(0, np.int64)
    hashes = np.fromiter(map(crc32, words), np.uint64, len(words))
    pairs = hashes[:-1] * np.uint64(0x9E3779B1) + hashes[1:]
    ends = {crc32(w[:ENDING], 1) for w in set(words)} | {crc32(w[-ENDING:], 2) for w in set(words)}
    mixed = np.concatenate((hashes, pairs, np.fromiter(ends, np.uint64, len(ends))))
    mixed = (mixed ^ (mixed >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    return np.flatnonzero(np.bincount((mixed % np.uint64(PLACES)).astype(np.int64), minlength=PLACES))


def gram_evidence(text: str | None, odds: np.ndarray) -> float:
    """The mean log odds of a text's n-grams, 0 for a text without words."""
    places = gram_places(text)
    return float(odds[places].mean()) if len(places) else 0.0


def gram_odds(counts: np.ndarray) -> np.ndarray:
    """Log odds of each place from how many bad and good documents have it, with their numbers
    in the last column."""
    share = (counts[:, :-1] + 1) / (counts[:, -1:] + 2)
    return np.log(share[1]) - np.log(share[0])


def count_grams(known: DataFrame) -> np.ndarray:
    """``[half, good, place]``: documents with an n-gram at each place, and in the last place all.

    Tasks add up vectors of that size, and Spark adds up those of a half and label.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 2, PLACES + 1), np.int64)
        for batch in text_blocks(batches):
            for half, quality, text in zip(*(batch.column(c).to_pylist()
                                             for c in ("half", "quality", "text"))):
                held = sums[half, int(quality > 0)]
                held[gram_places(text)] += 1
                held[-1] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([0, 1, 2, 3], pa.int64()),
             pa.array([x.tobytes() for x in sums.reshape(4, -1)], pa.binary())], ["cell", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("sums").to_pylist())
        return pa.table({"cell": table.column("cell")[:1],
                         "sums": pa.array([total.tobytes()], pa.binary())})

    kind, out = "cell long, sums binary", np.zeros((4, PLACES + 1), np.int64)
    for row in known.mapInArrow(run, kind).groupBy("cell").applyInArrow(add, kind).collect():
        out[row.cell] = np.frombuffer(row.sums, np.int64)
    return out.reshape(2, 2, PLACES + 1)


def features(text: str | None, odds: np.ndarray) -> list[float]:
    """What the shape of a text and its n-grams tell; all zero for a text without words."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), sum(map(len, words))
    letters = sum(map(str.isalpha, text))
    digits = sum(map(str.isdigit, text))
    upper = sum(map(str.isupper, words))
    counts = Counter(words)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return [
        np.log(n), letters / chars, upper / n, digits / chars, 1 - (letters + digits) / chars,
        len(MARK.findall(text)) / n, counts.get("|", 0) / n, len(counts) / n,
        counts.most_common(1)[0][1] / n, np.log(chars / n), repeats / n,
        np.log1p(n / (text.count("\n") + 1)), gram_evidence(text, odds),
    ]


def with_features(docs: DataFrame, kept: list[str], odds: np.ndarray) -> DataFrame:
    """Add ``features``. ``odds`` has a row of log odds for each ``half``, or one for all."""
    shared = docs.sparkSession.sparkContext.broadcast(odds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = shared.value
        for batch in text_blocks(batches, text="_text"):
            texts = batch.column("_text").to_pylist()
            halves = batch.column("half").to_pylist() if len(odds) > 1 else [0] * len(texts)
            made = [features(t, odds[h]) for t, h in zip(texts, halves)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(made, pa.list_(pa.float64()))],
                [*kept, "features"])

    schema = with_columns(docs.select(kept), "features array<double>")
    return docs.select(*kept, F.col("text").alias("_text")).mapInArrow(run, schema)


class Model:
    """Logistic regression on standardised features, less the log odds of its sample, so that
    ``evidence`` says how much the text moves any prior. ``odds`` are those of n-grams."""

    def __init__(self, x: np.ndarray, y: np.ndarray, odds: np.ndarray):
        self.odds = odds
        self.center = x.mean(axis=0) if len(x) else np.zeros(len(FEATURES))
        self.scale = x.std(axis=0) + 1e-6 if len(x) else np.ones(len(FEATURES))
        self.weights = np.zeros(2 * len(FEATURES) + 1)
        self.prior = 0.0
        if 0 < y.sum() < len(y):
            self.prior = float(np.log(y.mean() / (1 - y.mean())))
            self.fit(self.design(x), y)

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -6, 6)
        return np.concatenate((np.ones((len(z), 1)), z, z * z), axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Newton steps; the ridge keeps them finite where the classes do not overlap."""
        ridge = np.full(x.shape[1], RIDGE)
        ridge[0] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            slope = x.T @ (y - p) - ridge * self.weights
            curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
            step = np.linalg.solve(curve, slope)
            self.weights += step
            if np.abs(step).max() < 1e-6:
                break

    def evidence(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return np.clip(self.design(x) @ self.weights - self.prior, -MOST_LOGIT, MOST_LOGIT)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit the classifier to a bounded sample of ``labels(doc_id, quality)``.

    The log odds of n-grams are taken from one half of the sample where they judge the other,
    so the regression sees them as they are on texts not learnt from.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # Of rows that repeat an id one counts, whatever their number.
    known = settle(
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
        .withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")),
        "labelled")
    counts = count_grams(known)
    other = np.stack([gram_odds(counts[1]), gram_odds(counts[0])])
    rows = with_features(known, ["quality", "half"], other).select("quality", "features").collect()
    x = np.array([r.features for r in rows]).reshape(-1, len(FEATURES))
    return Model(x, np.array([float(r.quality > 0) for r in rows]),
                 gram_odds(counts.sum(axis=0)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def prior_count(sites: DataFrame, mean: Column) -> float:
    """How many documents the level above counts for, by the method of moments.

    ``sites`` has n and good, the sum of the probabilities. The spread of the rates around
    ``mean`` beyond what n documents scatter by chance is the spread of true rates.
    """
    rate, n = F.col("good") / F.col("n"), F.col("n").cast("double")
    chance = mean * (1 - mean)
    excess, weight, typical = sites.agg(
        F.sum(n * (rate - mean) * (rate - mean) - chance), F.sum(n - 1), F.avg(chance)).first()
    if not weight or excess is None or excess <= 0:
        return MOST_PRIOR
    spread = excess / weight
    return float(min(max(typical / spread - 1, LEAST_PRIOR), MOST_PRIOR))


def site_rates(judged: DataFrame, overall: float) -> DataFrame:
    """A row per path: host, path, n, good, the shrunk host_rate, path_prior and path_count.

    Sums are combined before they are shuffled, so a site with most documents costs no more
    than any other.
    """
    paths = judged.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.sum("p").alias("good"))
    paths = settle(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    hosts = settle(hosts, "hosts")
    count = prior_count(hosts, F.lit(overall))
    hosts = hosts.select(
        "host", ((F.col("good") + count * overall) / (F.col("n") + count)).alias("host_rate"))
    paths = paths.join(hosts, "host")
    within = prior_count(paths, F.col("host_rate"))
    return paths.withColumn("path_count", F.lit(within))


def score_quality(docs: DataFrame, model: Model, host: Column, path: Column) -> DataFrame:
    """One row per document: doc_id, evidence, host_rate, path_rate, score, keep.

    ``host`` and ``path`` say where a document is from; null counts as the site without
    name. A null or empty text has the evidence of a text without words. Rates are of all
    documents; ``path_rate`` leaves the document itself out. ``keep`` is a score of at least
    one half. Repeated rows each count and each give a row; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    placed = docs.select(
        "doc_id", F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"), "text")
    rows = with_features(placed, ["doc_id", "host", "path"], model.odds[None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))
            evidence = shared.value.evidence(x)
            p = 1 / (1 + np.exp(-(evidence + shared.value.prior)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "host", "path")],
                 pa.array(evidence), pa.array(p)],
                ["doc_id", "host", "path", "evidence", "p"])

    schema = with_columns(rows.drop("features"), "evidence double, p double")
    judged = settle(rows.mapInArrow(run, schema), "judged")
    total, good = judged.agg(F.count("*"), F.sum("p")).first()
    overall = (good + 1) / (total + 2) if total else 0.5
    sites = settle(site_rates(judged, overall), "sites")
    # Without the document itself, a site with it alone has its prior.
    others = (F.col("good") - F.col("p") + F.col("path_count") * F.col("host_rate")) / (
        F.col("n") - 1 + F.col("path_count"))
    rate = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), others))
    return (
        hot_join(judged, sites, ["host", "path"], "n", total)
        .withColumn("path_rate", rate)
        .withColumn("score", sigmoid(F.col("evidence") + logit(F.col("path_rate"))))
        .select("doc_id", "evidence", "host_rate", "path_rate", "score",
                (F.col("score") >= 0.5).alias("keep"))
    )
