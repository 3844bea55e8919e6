"""Every query against its DuckDB statement."""

import compare
import pytest

from avisgrid.catalog import QUERIES
from oracles import ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    got = compare.spark_result(QUERIES[name](spark, sf_dir))
    expected = compare.duckdb_result(con, ORACLES[name])
    assert compare.difference(got, expected) is None
