"""The exact-copy stage with null and repeated ids that have different texts."""

from collections import Counter

import pytest

from mailveil.llm.exact_dedup import drop_exact_copies


@pytest.mark.parametrize("keep, last", [("max", 4), ("min", 1)])
def test_null_and_repeated_ids(docs_of, keep, last):
    rows = [(1, "a"), (4, "a"), (None, "a"), (None, "b"), (None, "c"), (None, "c"),
            (5 - last, "d"), (None, None), (None, ""), (7, "e"), (7, "f"), (8, "g"), (8, "g")]
    docs = docs_of(rows)
    kept = drop_exact_copies(docs, keep)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter(
        [(last, "a"), (None, "b"), (None, "c"), (5 - last, "d"), (None, ""), (7, "e"), (7, "f"),
         (8, "g")])
