"""Every query of the reference's operators against its SQL, over whole tables."""

import pytest

from skywright.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(name, spark, sf_dir, same):
    assert name in catalogue.ORACLES
    same(catalogue.QUERIES[name](spark, sf_dir), catalogue.ORACLES[name])


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(5).count() == 5
    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
