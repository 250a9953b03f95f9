"""Ordered bags of values per owner, before and after: what was lost, what was gained, what only moved."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def differences(before: DataFrame, after: DataFrame, keys: list[str], value: str = "value", place: str = "place") -> DataFrame:
    """``keys, change, value, n``: ``lost`` and ``gained`` values with their number, and ``moved`` places.

    Values are counted as often as they come, nulls as a value; counts are
    gathered per task before the shuffle, so a value that is everywhere is a row
    a task.  Where an owner's bags are equal, values that left their place are
    ``moved`` (``n``: how many, each counted at the place that it left).  A null
    key is a key, a null place a place.
    """
    told = lambda df, n: df.select(*keys, F.col(place).alias("place"), F.col(value).cast("string").alias("value"), F.lit(n).alias("n"))
    spots = told(before, 1).unionByName(told(after, -1)).groupBy(*keys, "place", "value").agg(F.sum("n").alias("n"))
    left = F.sum(F.greatest("n", F.lit(0)))
    whole = spots.where("n <> 0").groupBy(*keys, "value").agg(F.sum("n").alias("net"), left.alias("left"))
    # An owner with any net change has no moves; one row a value, so the window is over values and not rows.
    settled = whole.withColumn("even", F.max(F.abs("net")).over(Window.partitionBy(*keys)) == 0)
    change = F.when(F.col("net") > 0, "lost").when(F.col("net") < 0, "gained").when(F.col("even") & (F.col("left") > 0), "moved")
    return settled.select(*keys, change.alias("change"), "value", F.when(F.col("net") != 0, F.abs("net")).otherwise(F.col("left")).alias("n")).where("change IS NOT NULL")
