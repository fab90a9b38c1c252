"""Every named query of the core against its SQL on the smallest tables."""

import pytest

from lakewarden.plans import problems, reference  # noqa: F401
from lakewarden.plans.registry import ORACLE, QUERIES

from .oracle import compare, connect


@pytest.fixture(scope="module")
def db(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, small, db, name):
    compare(spark, small, db, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(problems.oracle_sql()))
def test_problem(spark, small, db, name):
    compare(spark, small, db, problems.queries()[name], problems.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["actor", "start_us", "end_us", "event_count"]
