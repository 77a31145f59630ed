"""Every registered query against its DuckDB statement on the smallest test tables."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from spinecat.plans import oracle, registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_a_statement():
    assert set(oracle.STATEMENTS) == set(registry.QUERIES)
    assert set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_same_rows(spark, con, name):
    assert compare(spark, con, SF, name) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
