"""Every registered query of the engine's own operators against its SQL."""

import pytest
from oracle import connect, rows_of, rows_of_sql

from terrane.plans.registry import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, con, name):
    assert rows_of(QUERIES[name](spark, sf_dir)) == rows_of_sql(con, ORACLE[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
