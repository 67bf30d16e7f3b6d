"""Every registered query against its SQL, on the smallest data."""

import pytest

from larder.catalog import CHECKS, QUERIES
from tests.compare import difference, duck
from tests.laws import LAWS

# seconds each rather than milliseconds; run them with `python -m tests.compare`
SLOW = {"cmp01_composition", "cmp10_embedded"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, con, sf_dir, name):
    assert difference(spark, con, sf_dir, name) is None


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


def test_every_query_has_sql_or_a_law():
    assert set(QUERIES) == set(CHECKS) | set(LAWS)
