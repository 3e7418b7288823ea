"""Every registered query against its SQL, on whole tables."""

import pytest
from compare import connect, difference, duck_bag, plan_text, spark_bag

from tabgauge.plans import catalogue

CALLS = catalogue.callables()
# model queries take several MLlib jobs each and have their own tests
ROWS_ONLY = [n for n in CALLS if n not in catalogue.ORACLES and not n.startswith(("trial_", "refit_"))]


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = CALLS[name](spark, sf_dir)
    plan = plan_text(df)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert difference(spark_bag(df), duck_bag(duck, catalogue.ORACLES[name])) is None


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_query_gives_rows(spark, sf_dir, name):
    assert CALLS[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
