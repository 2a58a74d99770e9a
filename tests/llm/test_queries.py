"""Registered queries against their DuckDB statements, and the tables of the driver."""

import pytest

import __spark_entry__ as entry_points
from schemaloom.llm import catalog
from tests.compare import connect, difference
from tests.llm.conftest import SF


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, name):
    assert difference(catalog.QUERIES[name](spark, SF), connect(SF), catalog.ORACLES[name]) is None


def test_all_are_registered():
    assert set(catalog.QUERIES) | {"pipeline"} <= set(entry_points.queries())
    assert {q.split("_")[0] for q in catalog.QUERIES} == {f"op{n}" for n in range(1, 14)}
