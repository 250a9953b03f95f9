"""Inheritance along parent links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def inherit(nodes: DataFrame, key: str, parent: str, props: list[str]) -> DataFrame:
    """``key`` and ``props``, a missing one taken from the nearest ancestor that has it.

    Each round joins every node to an ancestor twice as far away; the rounds that
    the number of nodes asks for reach the end of any chain.  What still has an
    ancestor then hangs on a cycle: the properties found on it are inherited and
    the rest stay null.
    """
    state = cut(nodes.select(key, F.col(parent).alias("up"), *props))
    for _ in range(state.count().bit_length() + 1):
        if state.where(F.col("up").isNotNull()).isEmpty():
            break
        above = state.select(F.col(key).alias("__key"), F.col("up").alias("__up"), *[F.col(p).alias(f"__{p}") for p in props])
        taken = [F.coalesce(p, f"__{p}").alias(p) for p in props]
        state = cut(state.join(above, F.col("up") == F.col("__key"), "left").select(key, F.col("__up").alias("up"), *taken))
    return state.drop("up")


def closure(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """``key, node, depth``: every node with itself (depth 0) and all its ancestors, named parents without a row of their own included.

    Each round goes one link further up for all nodes at once, as one join; who
    was found before is not found again, so a cycle ends after one turn.
    """
    own = cut(nodes.select(F.col(key).alias("__node"), F.col(parent).alias("__up")).where("__up IS NOT NULL"))
    level = cut(nodes.select(key, F.col(key).alias("node"), F.lit(0).alias("depth")))
    out = level
    while True:
        further = level.join(own, F.col("node") == F.col("__node")).select(key, F.col("__up").alias("node"), (F.col("depth") + 1).alias("depth"))
        level = cut(further.join(out.select(key, "node"), [key, "node"], "left_anti"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
