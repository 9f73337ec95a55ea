from __future__ import annotations

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_repeated_rows_stay_once(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "x"), (1, text, "x"), (2, text, "x"), (3, "another text of its own words", "x"), (3, "another text of its own words", "x"), (4, None, "x"), (4, None, "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, count string")
    found = pipeline.without_near_duplicates(spark, docs, "")
    assert found.columns == docs.columns and sorted((r["doc_id"] or 0) for r in found.collect()) == [0, 1, 3, 4]
