"""Every registered query against its SQL."""

import compare
import pytest

import __spark_entry__ as entry_points
from arcloom.plans.catalog import QUERIES
from arcloom.plans.oracle import ORACLE

SF_DIR = f"{compare.SF_ROOT}/sf0.001"


@pytest.fixture(scope="module")
def db():
    return compare.database(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.items() <= entry_points.queries().items() and ORACLE.items() <= entry_points.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    result = entry_points.queries()[name](spark, SF_DIR)
    assert compare.difference(result, db, entry_points.oracle_sql()[name]) is None


def test_entry_counts_every_pattern(spark):
    result = entry_points.entry(spark)
    assert result.columns == ["pid", "n"]
    assert result.count() == 150
