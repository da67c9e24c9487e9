"""Queries whose rows are much work: a table of one small file is more than one task."""

import pytest
from helpers import SF

from pulsegrid.plans import record_queries


@pytest.mark.parametrize("name", ["metadata_problems", "configuration_problems", "noise_recipe"])
def test_rows_of_one_file_are_many_tasks(spark, name):
    frame = getattr(record_queries, name)(spark, SF)
    assert sum(1 for n in frame.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n) == 4
