"""The covering join stays a shuffle."""

from folioframe.llm import simhash


def test_replicated_rows_are_not_broadcast(spark):
    """69 rows a fingerprint, which Spark takes for one, would pass whole through the driver."""
    found = simhash.links(spark.range(2_000).selectExpr("xxhash64(id) AS fp").unionAll(spark.sql("SELECT xxhash64(7L) ^ 5 AS fp")))
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
