"""Every registered query against its SQL on the smallest driver tables."""

import pytest

from shiftlab_checks.compare import compare, open_tables
from shiftlab_checks.oracles import ORACLES
from shiftlab_checks.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return open_tables(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, connection, name):
    result = compare(spark, connection, SMALL, name)
    assert result["match"], result
    assert result["rows"] > 0
