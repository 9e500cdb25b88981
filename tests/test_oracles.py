"""Every registered query with a DuckDB counterpart gives the same rows."""

import pytest

import __spark_entry__ as contract
import compare

ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return compare.duck(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, folder, name):
    df = contract.queries()[name](spark, folder)
    ours, names = compare.spark_rows(df)
    theirs, other_names = compare.duck_rows(con, ORACLES[name])
    assert names == other_names
    mine, other = compare.families(df, con, ORACLES[name])
    assert mine == other
    assert ours == theirs


def test_entry_returns_rows(spark):
    assert contract.entry(spark).limit(1).count() == 1


def test_names_keep_to_the_rules():
    assert set(ORACLES) <= set(contract.queries())
