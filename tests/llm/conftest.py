import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session", autouse=True)
def workers_import(spark):
    """Python workers import the package wherever pytest was started."""
    spark.sparkContext.environment["PYTHONPATH"] = ROOT


@pytest.fixture
def docs_of(spark):
    """Documents with the columns of the table and a few whose names clash with results."""
    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, "
                  "score string, n_tokens int").repartition(3)

    return make


# Nulls, empty and blank texts, ties, repeated rows, a null id, a very long text.
ODD_ROWS = [
    (1, "alpha beta gamma delta epsilon"), (2, "alpha beta gamma delta epsilon"),
    (3, None), (4, ""), (5, " \t\n "), (6, "Ünï 日本語 🙂 \x00 </s> ▁ x"), (7, "a" * 50_000),
    (8, "word " * 20_000), (9, "ALPHA beta\r\ngamma  delta"), (9, "ALPHA beta\r\ngamma  delta"),
    (None, "alpha beta gamma delta epsilon"), (11, "   " * 33), (12, "12345 !!! ???"),
]


@pytest.fixture
def odd_rows():
    return list(ODD_ROWS)
