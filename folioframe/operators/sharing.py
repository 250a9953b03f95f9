"""Which lists may be turned over: a list shares its fate with all that hangs together with it.

Lists, their definitions and the styles that number by them are the nodes of a
graph; a component is convertible only if each paragraph and list in it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Why a list can't be turned over, in the order told; each is a bit of a list's mask.
REASONS = ("no_definition", "not_handled", "other_role", "override", "restart", "start")


def components(links: DataFrame, owner: str = "path") -> DataFrame:
    """``owner, node, root`` of the nodes that ``links`` (owner, src, dst) name; root is the least node that is connected, within an owner.

    Each round every node takes the least root among its own and its
    neighbours', and then that root's root, so ways shrink by half; lineage is
    cut each time.  Loops, repeats and cycles are no harm.
    """
    both = links.select(owner, F.col("src").alias("node"), F.col("dst").alias("near")).unionByName(links.select(owner, F.col("dst").alias("node"), F.col("src").alias("near")))
    both = cut(both.distinct())
    roots = cut(both.select(owner, "node").distinct().withColumn("root", F.col("node")))
    while True:
        near = both.join(roots.select(owner, F.col("node").alias("near"), F.col("root").alias("r")), [owner, "near"]).groupBy(owner, "node").agg(F.min("r").alias("r"))
        least = cut(roots.join(near, [owner, "node"], "left").select(owner, "node", F.least("root", F.coalesce("r", "root")).alias("next"), F.col("root").alias("was")))
        further = least.select(owner, F.col("node").alias("next"), F.col("next").alias("beyond"))
        told = cut(least.join(further, [owner, "next"], "left").select(owner, "node", F.least("next", F.coalesce("beyond", "next")).alias("root"), "was"))
        roots = told.drop("was")
        if told.where("root <> was").isEmpty():
            return roots


def convertible_lists(paragraphs: DataFrame, numbers: DataFrame, style_numbers: DataFrame) -> DataFrame:
    """``path, num_id, component, paragraphs, convertible, reasons``: one row per list that is defined or used.

    ``paragraphs``: ``path, paragraph_index, num_id, role, proven_role,
    handled`` (the list that numbers it, by itself or by its style, null for
    none; the role given, the one its numbering proves, whether it is among
    those to be converted).
    ``numbers``: ``path, num_id, abstract_id, start, overridden, restart`` (a
    row a list and level; start null counts as 1).  ``style_numbers``: ``path,
    style, num_id``.  ``reasons``, sorted: ``not_handled``, ``other_role`` (given
    and proven differ), ``no_definition``, ``start``, ``override``, ``restart``;
    one anywhere in a component holds for all its lists.
    """
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    num, none = F.col("num_id").cast("string").alias("num_id"), F.lit(None)
    handled = F.coalesce("handled", F.lit(False))
    wrong = {"not_handled": ~handled, "other_role": handled & ~F.col("role").eqNullSafe(F.col("proven_role"))}
    bad = {"no_definition": F.col("abstract_id").isNull(), "start": F.coalesce(F.col("start").cast("string"), F.lit("1")) != "1", "override": F.coalesce("overridden", F.lit(False)), "restart": F.coalesce("restart", F.lit(False))}
    mask = lambda tests: reduce(lambda x, y: x.bitwiseOR(y), [F.when(bad, 1 << REASONS.index(r)).otherwise(0) for r, bad in tests.items()])
    # What is known of a list, from all three tables, in one shuffle of one row a list and task.
    facts = (
        paragraphs.select("path", num, none.cast("string").alias("hub"), mask(wrong).alias("mask"), F.lit(1).cast("long").alias("used"), F.lit(False).alias("defined"))
        .unionByName(numbers.select("path", num, node("abstract", "abstract_id").alias("hub"), mask(bad).alias("mask"), F.lit(0).cast("long").alias("used"), F.lit(True).alias("defined")))
        .unionByName(style_numbers.select("path", num, node("style", "style").alias("hub"), F.lit(0).alias("mask"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("defined")))
    ).where("num_id IS NOT NULL")
    of_list = facts.groupBy("path", "num_id").agg(F.array_sort(F.collect_set("hub")).alias("hubs"), F.bit_or("mask").alias("mask"), F.sum("used").alias("used"), F.max("defined").alias("defined"))
    undefined = F.when((F.col("used") > 0) & ~F.col("defined"), 1 << REASONS.index("no_definition")).otherwise(0)
    own = cut(of_list.select("path", "num_id", "hubs", F.col("mask").bitwiseOR(undefined).alias("mask"), F.col("used").alias("paragraphs")))
    # A list ties the first of its definitions and styles to the others; few are tied, so the rounds see little.
    hub = F.get("hubs", F.lit(0))
    ties = own.where("size(hubs) > 1").select("path", hub.alias("src"), F.explode(F.slice("hubs", 2, F.size("hubs"))).alias("dst")).distinct()
    roots = components(ties).select("path", F.col("node").alias("hub"), "root")
    lists = own.select("path", "num_id", "mask", "paragraphs", hub.alias("hub")).join(roots, ["path", "hub"], "left")
    lists = lists.withColumn("root", F.coalesce("root", "hub", node("num", "num_id")))
    whole = Window.partitionBy("path", "root")
    told = lists.withColumn("component", F.min(F.least("root", node("num", "num_id"))).over(whole)).withColumn("mask", F.bit_or("mask").over(whole))
    reasons = F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(1 << i) > 0, r) for i, r in enumerate(REASONS)]))
    return told.select("path", "num_id", "component", "paragraphs", (F.col("mask") == 0).alias("convertible"), reasons.alias("reasons"))
