"""The registered queries, and the pipeline against its definition."""

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from mailveil.llm.queries import ORACLES, QUERIES
from tools.compare import connect, differences


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, small, name):
    rows, problem = differences(spark, connect(small), small, name)
    assert problem is None and rows > 0


# Their rows are conversations and phrases.
OTHER_ROWS = {"op11_conversation_repair", "op13_collocations"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - OTHER_ROWS))
def test_a_row_per_document(spark, small, name):
    rows = queries()[name](spark, small)
    assert rows.count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_a_row_per_conversation(spark, small):
    rows = queries()["op11_conversation_repair"](spark, small)
    ids = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id").distinct()
    assert rows.count() == ids.count() == rows.join(ids, "conv_id").count()


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(ORACLES) <= set(oracle_sql())


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.settle(stage(spark, docs, small), name)
        assert kept.columns == columns and 0 < kept.count() <= seen
        assert kept.exceptAll(docs).count() == 0
        docs, seen = kept, kept.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert last.count() == seen
    assert docs.select("text").distinct().count() == seen


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, small, docs_of, odd_rows, stage):
    docs = docs_of([r for r in odd_rows if r[0] is not None]).drop("score", "n_tokens")
    assert stage(spark, docs, small).count() <= len(odd_rows)
    assert stage(spark, docs.limit(0), small).count() == 0
