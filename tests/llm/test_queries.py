from __future__ import annotations

import os

import pytest

import corpus_pipeline
from ledgerlens.llm import decontam, queries
from tests.oracle import SF_DIR, assert_equal, connection

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    assert_equal(queries.QUERIES[name](spark, SF_DIR), connection(), queries.ORACLES[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept, ids = docs, {r[0] for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF_DIR)
        assert after.columns == docs.columns
        now = {r[0] for r in after.select("doc_id").collect()}
        assert now and now <= ids
        kept, ids = after, now
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    assert decontam.contaminated(kept, items).count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, kept, SF_DIR).toPandas()
    assert set(out["doc_id"]) == ids and out.groupby("sequence_id")["length"].sum().max() <= 4096


def test_pipeline_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 34", "en", "s", 5), (4, "some plain words here " * 3000, "en", "s", 1), (5, "some plain words here " * 3000, "en", "s", 1), (5, "some plain words here " * 3000, "en", "s", 1)]
    for part in (rows, []):
        docs = spark.createDataFrame(part, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF_DIR)
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
        assert {r["doc_id"] for r in out.collect()} <= {4}
