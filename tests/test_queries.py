"""Every registered query of the signal engine against its SQL."""

import pytest
from helpers import SF, rows_of

import pulsegrid.plans.long_queries
import pulsegrid.plans.record_queries  # noqa: F401
from pulsegrid.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
