"""Every registered query against its DuckDB statement."""

import pytest

import __spark_entry__ as entry_points
from schemaloom.plans.catalog import QUERIES
from schemaloom.plans.oracles import ORACLES
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    assert difference(QUERIES[name](spark, SF), duck, ORACLES[name]) is None


def test_only_lineage_replay_has_no_statement():
    assert set(QUERIES) - set(ORACLES) == {"replay_with_lineage"}
    assert QUERIES.keys() <= entry_points.queries().keys() and ORACLES.keys() <= entry_points.oracle_sql().keys()


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1000
