"""What a task holds doesn't grow with the tables: plans of the queries that failed at size."""

import pytest

from folioframe.plans import catalogue
from folioframe.sources import tables

SMALL = "/root/testdata/sf0.001"


def _plan(spark, query):
    return catalogue.QUERIES[query](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_parts_grow_with_the_rows(spark):
    assert tables.parts_for(spark.range(10), 3) == 4 and tables.parts_for(spark.range(101), 10) == 11 and tables.parts_for(spark.range(0), 10) == 4


@pytest.mark.parametrize("query", ["sequence_faults", "sequence_violations", "gated_roles", "conversion_preconditions"])
def test_documents_are_dealt_by_the_number_of_lines(spark, query):
    assert "REPARTITION_BY_NUM" in _plan(spark, query)
