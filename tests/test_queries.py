"""Every registered query against its SQL on the whole small tables."""

import pytest
from compare import compare, duck
from conftest import SMALL

import __spark_entry__ as contract

CHECKS = contract.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, connection, name):
    assert compare(spark, connection, SMALL, contract.queries()[name], CHECKS.get(name)) is None


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(contract.queries())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
