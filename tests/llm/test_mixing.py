"""Mixing to target weights: targets by exact fractions, draws, odd tables."""

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from mailveil.llm import mixing


def fractions(sizes, weights=(1, 2, 3), most=3):
    """Targets by resharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in held]
        left = total - sum(most * sizes[s] for s in held)
        share = {s: Fraction(left * weight[s], sum(weight[f] for f in free)) for s in free}
        above = {s for s in free if share[s] > most * sizes[s]}
        if not above:
            return {s: Fraction(most * sizes[s]) if s in held else share[s] for s in names}
        held |= above


@pytest.fixture
def sized(spark):
    def make(sizes):
        rows = [(s, n) for s, total in sizes.items() for n in (total - total // 2, total // 2)]
        return spark.createDataFrame(rows, "source string, size long").repartition(3)

    return make


@pytest.mark.parametrize("seed", range(4))
def test_targets(sized, seed):
    dice = random.Random(seed)
    sizes = {f"s{i}": int(10 ** dice.uniform(0, 6)) for i in range(7)} | {"é": 9, None: 50}
    got = {r.source: r for r in mixing.source_targets(sized(sizes)).collect()}
    want = fractions(sizes)
    assert set(got) == set(want)
    for name, target in want.items():
        assert got[name].source_size == sizes[name]
        assert got[name].target == pytest.approx(float(target), rel=1e-12)
        assert got[name].rate <= 3
    assert sum(r.target for r in got.values()) == pytest.approx(sum(sizes.values()))


@pytest.mark.parametrize("sizes", [{}, {"a": 0}, {"a": 5}, {"a": 0, "b": 7, None: 0}])
def test_targets_at_the_edges(sized, spark, sizes):
    rows = sized(sizes) if sizes else spark.createDataFrame([], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got == {s: float(t) for s, t in fractions(sizes).items()} if sum(sizes.values()) else (
        all(t == 0 for t in got.values()))


def test_taken_words_come_near_their_target(spark):
    """Within four deviations of independent draws for each source, and closer on the whole."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rate = F.col("target") / F.col("source_size")
    spread = F.pow("size", F.lit(2)) * (rate - F.floor(rate)) * (F.floor(rate) + 1 - rate)
    by = mixing.mix_report(docs).groupBy("source_size", "target").agg(
        F.sum("taken").alias("taken"), F.sqrt(F.sum(spread)).alias("deviation"),
        F.max(F.col("taken") / F.col("size")).alias("most")).collect()
    for r in by:
        assert abs(r.taken - r.target) <= 4 * r.deviation + 1 and r.most <= 3
    assert sum(r.taken for r in by) == pytest.approx(sum(r.target for r in by), rel=0.03)


def test_runs_agree(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one = mixing.mix_report(docs)
    two = mixing.mix_report(docs.repartition(7))
    assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0


def test_documents_are_emitted_as_planned(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(docs).collect()}
    out = mixing.mix_documents(docs.withColumn("copies", F.lit("x")))
    assert out.columns == [*docs.columns, "copies", "copy"]
    seen = {}
    for r in out.select("doc_id", "copy").collect():
        seen.setdefault(r.doc_id, []).append(r["copy"])
    assert {i: sorted(c) for i, c in seen.items()} == {
        i: list(range(n)) for i, n in plan.items() if n}


def test_odd_rows(spark, docs_of, odd_rows):
    rows = mixing.mix_report(docs_of(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        text = next(t for i, t in odd_rows if i == r.doc_id) or ""
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text))
        assert 0 <= r.taken <= 3 * r.size
    again = [r.taken for r in rows if r.doc_id == 9]
    assert again[0] == again[1]
    assert mixing.mix_report(docs_of([])).count() == 0
