from __future__ import annotations

import os

import pytest

from ledgerlens.plans import catalogue, catalogue_rows, catalogue_scale  # noqa: F401  (the others add to the first)
from tests.oracle import SF_DIR, assert_equal, connection

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, con, name):
    assert_equal(catalogue.QUERIES[name](spark, SF_DIR), con, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF_DIR).count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.queries().keys() >= catalogue.QUERIES.keys() and entry.oracle_sql().keys() <= entry.queries().keys()
    if SF_DIR.endswith("sf0.001"):
        assert entry.entry(spark).count()
