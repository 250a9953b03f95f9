"""Connected components keep Spark's estimate of their size in proportion to the links, however many rounds they take."""

from pyspark.sql import functions as F

from folioframe.llm.components import components


def _bits(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_estimates_do_not_grow_by_round(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    # One after the other, as the near stage does: the second starts from what the first left.
    once = components(links, "a", "b")
    twice = components(once, "node", "root")
    assert {tuple(r) for r in twice.collect()} == {(i, 0) for i in range(61)}
    assert _bits(once) <= 64 and _bits(twice) <= 64
