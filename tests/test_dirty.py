"""All queries on dirty and on empty tables: they end, with a stable schema."""

import pytest

from lakewarden.plans import problems, reference  # noqa: F401
from lakewarden.plans.registry import QUERIES

from .dirty import write

ALL = {**QUERIES, **problems.queries()}


@pytest.fixture(scope="module")
def dirty(spark, small, tmp_path_factory):
    return write(spark, small, tmp_path_factory.mktemp("dirty"), False)


@pytest.fixture(scope="module")
def empty(spark, small, tmp_path_factory):
    return write(spark, small, tmp_path_factory.mktemp("empty"), True)


@pytest.mark.parametrize("name", sorted(ALL))
def test_dirty(spark, dirty, name):
    assert ALL[name](spark, dirty).count() >= 0


@pytest.mark.parametrize("name", [*sorted(problems.queries()), "enforce_policy", "pairwise_self_join", "by_model", "map_task_best_rule", "attack_matches", "pii_scan_lines"])
def test_empty(spark, empty, name):
    n = ALL[name](spark, empty).count()
    # Texts of no document are still no row; aggregates by key have none either.
    assert n == 0
