"""Connected components of a large graph, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, stored, text_or_empty


def _stars(pairs: DataFrame) -> DataFrame:
    """One large-star and one small-star step over ``(big, small)``, big > small.

    A node's neighbours are told the least node among them; the grouped minimum
    is pre-aggregated, so a node with very many links is a few rows a task.  The
    minima are materialised, so that the joins deal both sides anew and the
    links of such a node can be split among tasks.
    """
    both = pairs.select(F.col("big").alias("node"), F.col("small").alias("near")).unionByName(pairs.select(F.col("small").alias("node"), F.col("big").alias("near")))
    least = cut(both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("least")))
    large = cut(both.where("near > node").join(least, "node").select(F.col("near").alias("big"), F.col("least").alias("small")).distinct())
    low = cut(large.groupBy("big").agg(F.min("small").alias("least")))
    told = large.join(low, "big")
    small = told.select(F.col("small").alias("big"), F.col("least").alias("small")).where("big > small")
    return small.unionByName(low.select("big", F.col("least").alias("small"))).distinct()


def components(links: DataFrame, src: str, dst: str) -> DataFrame:
    """``node, root`` for every node of a link, root the least node reachable.

    Links have no direction; loops and repeats don't matter.  Each round at
    least halves the longest way to a root.  What a round leaves is written and
    read again, as a checkpoint would keep Spark's estimate of its size: a
    product over all joins before, with several times as many digits each round.
    """
    a, b = F.col(src), F.col(dst)
    pairs = stored(links.where(a != b).select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small")).distinct())
    total = None
    while True:
        before, pairs = pairs, stored(_stars(pairs))
        forget(links.sparkSession, before)
        # Done when every node has one root and no root has one of its own.
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first()
        if now == total:
            break
        total = now
    roots = pairs.select(F.col("small").alias("node"), F.col("small").alias("root")).distinct()
    return pairs.select(F.col("big").alias("node"), F.col("small").alias("root")).unionByName(roots)


def one_of_each(rows: DataFrame, key: str, roots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The ``rows`` without all but one of each group that ``roots`` (node, root) makes of their ``key``.

    The row with the least id stays, nulls after all ids; of one id the one with
    the least text digest, then any one of equal rows.  Rows in no group stay.
    """
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.sha2(text_or_empty(text_col).cast("binary"), 256).alias("sha"), F.col(key).alias("key"))
    told = roots.join(rows.select(F.col(key).alias("node"), order.alias("order")), "node")
    first = told.groupBy("root").agg(F.min("order").alias("first")).select(F.col("first.key").alias("node"))
    gone = cut(roots.select("node").join(first, "node", "left_anti"))
    return rows.join(gone.select(F.col("node").alias(key)), key, "left_anti")
