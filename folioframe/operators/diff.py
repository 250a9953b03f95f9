"""Before/after comparison of two versions of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, kind, changed``: added, removed and changed rows, ``changed`` naming the columns.

    Keys must be unique on each side.  Nulls equal nulls.
    """
    b = before.select(F.col(key).alias("__b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    a = after.select(F.col(key).alias("__a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    both = b.join(a, F.col("__b") == F.col("__a"), "full_outer")
    differs = [F.when(~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}")), c) for c in columns]
    kind = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").when(reduce(lambda x, y: x | y, [d.isNotNull() for d in differs]), "changed")
    named = F.when(kind == "changed", F.concat_ws(",", *differs)).otherwise("")
    return both.select(F.coalesce("__b", "__a").alias(key), kind.alias("kind"), named.alias("changed")).where("kind IS NOT NULL")


def disallowed(found: DataFrame, allowed: list[str]) -> DataFrame:
    """The rows of ``changes`` that add, remove, or change a column outside ``allowed``."""
    extra = F.size(F.array_except(F.split("changed", ","), F.array(*map(F.lit, allowed))))
    return found.where((F.col("kind") != "changed") | (extra > 0))
