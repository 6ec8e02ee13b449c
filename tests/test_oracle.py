"""Every registered query against its SQL, values and column types."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry
from pagemill.oracle import ORACLE
from pagemill.registry import QUERIES
from tests.check_oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()


def test_names():
    assert not [n for n in QUERIES if "pipeline" in n or n.startswith("op")]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, detail = compare(spark, con, SF_DIR, name)
    assert ok, detail


def test_entry(spark):
    result = entry(spark)
    assert result.columns == ["prompt_id", "roles", "first", "second"]
    assert result.count() == 60
