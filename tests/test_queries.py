"""Every registered query against its SQL in DuckDB."""

import pytest
from compare import database, differences

from __spark_entry__ import entry
from weftbook.plans.oracle import ORACLE
from weftbook.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, sf_dir, con):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLE[name]) == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark, sf_dir):
    result = entry(spark)
    assert result.columns[:3] == ["id", "title", "slug"]
    assert result.count() > 0
