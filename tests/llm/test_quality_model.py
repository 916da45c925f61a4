"""What n-grams add to the quality classifier, and the shrunk rates against plain sums."""

import random

import numpy as np
from pyspark.sql import functions as F

from mailveil.llm import quality


def test_words_decide_where_shape_does_not(spark):
    """Texts of one shape, good or bad by their words alone; held-out documents."""
    dice = random.Random(3)
    good, bad = ([f"{c}{dice.randrange(10 ** 4):04}" for _ in range(60)] for c in "gb")
    common = [f"c{dice.randrange(10 ** 4):04}" for _ in range(200)]
    rows = [(i, " ".join(dice.choice((good if i % 2 else bad) if dice.random() < .15 else common)
                         for _ in range(80))) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "s", "l") for i, t in rows],
                                 "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    held = [(quality.features(t, model.odds), i % 2) for i, t in rows[200:]]
    x, y = np.array([f for f, _ in held]), np.array([q for _, q in held])
    assert np.mean((model.evidence(x) > 0) == y) > 0.95
    # Without the n-grams the same regression can only guess.
    blind = x.copy()
    blind[:, quality.FEATURES.index("grams")] = model.center[quality.FEATURES.index("grams")]
    assert np.mean((model.evidence(blind) > 0) == y) < 0.7


def test_a_repeated_id_teaches_once(spark):
    rows = [(1, f"word {k}") for k in range(600)] + [(2, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.train(docs, labels).odds.shape == (quality.PLACES,)


def test_rates_equal_plain_sums(spark):
    dice = random.Random(5)
    rows = [(k, f"h{k % 7}", f"h{k % 7}/p{k % 21}", dice.random() ** (1 + k % 7)) for k in range(900)]
    judged = spark.createDataFrame(rows, "doc_id long, host string, path string, p double")
    overall = 0.4
    hosts = {}
    for _, h, _, p in rows:
        hosts.setdefault(h, []).append(p)

    def prior(groups):
        """By moments: (n, sum, mean of the level above) of each site."""
        excess = sum(n * (g / n - m) ** 2 - m * (1 - m) for n, g, m in groups)
        weight, typical = sum(n - 1 for n, _, _ in groups), np.mean([m * (1 - m) for _, _, m in groups])
        if not weight or excess <= 0:
            return quality.MOST_PRIOR
        return min(max(typical / (excess / weight) - 1, quality.LEAST_PRIOR), quality.MOST_PRIOR)

    count = prior([(len(v), sum(v), overall) for v in hosts.values()])
    want = {h: (sum(v) + count * overall) / (len(v) + count) for h, v in hosts.items()}
    paths = {}
    for _, h, q, p in rows:
        paths.setdefault((h, q), []).append(p)
    within = prior([(len(v), sum(v), want[h]) for (h, _), v in paths.items()])
    got = quality.site_rates(judged, overall).collect()
    assert len(got) == len(paths)
    for r in got:
        assert r.n == len(paths[r.host, r.path]) and np.isclose(r.good, sum(paths[r.host, r.path]))
        assert np.isclose(r.host_rate, want[r.host]) and np.isclose(r.path_count, within)
