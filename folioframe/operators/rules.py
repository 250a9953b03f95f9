"""Rules that several rows decide together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def consensus(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``keys`` and of each of ``values`` the one that all rows of a key agree on; null where they differ.

    A null counts as a value of its own, so it agrees with nulls only.
    """
    one = [F.when((F.count(v) == F.count("*")) & (F.min(v) == F.max(v)), F.min(v)).alias(v) for v in values]
    return rows.groupBy(*keys).agg(*one)


def exact_match(rows: DataFrame, known: DataFrame, signature: list[str], role: str) -> DataFrame:
    """``rows`` with ``role`` of the one known row that has their whole signature, and ``conflict``.

    Null equals null.  More than one known role for a signature is no match but
    a conflict.  ``known`` is folded to a row a signature first, so copies in it
    neither multiply nor skew the join.
    """
    folded = known.groupBy(*signature).agg(F.min(role).alias("__low"), F.max(role).alias("__high"))
    same = [F.col(f"r.{x}").eqNullSafe(F.col(f"k.{x}")) for x in signature]
    on = same[0]
    for x in same[1:]:
        on = on & x
    joined = rows.alias("r").join(folded.alias("k"), on, "left")
    agreed = F.col("__low") == F.col("__high")
    return joined.select("r.*", F.when(agreed, F.col("__low")).alias(role), F.coalesce(~agreed, F.lit(False)).alias("conflict"))


def uncovered(required: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n``: how many required rows of each key have no covering row; keys with none are left out."""
    return required.join(covered.select(*keys).distinct(), keys, "left_anti").groupBy(*keys).agg(F.count("*").alias("n"))


def dangling(references: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """``key, uses``: keys that are referred to and have no target; a null key never has one.

    References are counted first, so the join has a row a key.
    """
    return references.groupBy(key).agg(F.count("*").alias("uses")).join(targets.select(key).distinct(), key, "left_anti")


def duplicates(rows: DataFrame, key: str, first: str) -> DataFrame:
    """``folded, n, first_id``: values of ``key`` that several rows have, letters folded; null equals null."""
    return rows.groupBy(F.lower(key).alias("folded")).agg(F.count("*").alias("n"), F.min(first).alias("first_id")).where("n > 1")


def outcomes(targets: DataFrame, run: str, succeeded: str) -> DataFrame:
    """``run, succeeded, failed, status`` of runs: ``succeeded``, ``failed`` or ``partial_failure``; a null outcome is a failure."""
    good = F.count_if(F.coalesce(succeeded, F.lit(False)))
    counted = targets.groupBy(run).agg(good.alias("succeeded"), (F.count("*") - good).alias("failed"))
    return counted.withColumn("status", F.when(F.col("failed") == 0, "succeeded").when(F.col("succeeded") == 0, "failed").otherwise("partial_failure"))


def fresh_ids(wanted: DataFrame, taken: DataFrame, name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """``within, name, id`` of the wanted names: eight hex digits of a digest that neither ``taken`` (``within, id``) nor each other have.

    A name whose digest is taken tries again with a number behind it; of names
    that meet in one digest the least gets it.  Ids need to differ only where
    the columns ``within`` are the same, and a name has one there; rows with a
    null among these or as name have none.  Reruns agree.
    """
    own = [*within, name]
    left = cut(wanted.select(*own).dropna().distinct())
    used, out, salt = taken.select(*within, "id").distinct(), None, 0
    while not left.isEmpty():
        tried = left.withColumn("id", F.upper(F.left(F.sha1(F.concat(name, F.lit(f"#{salt}" if salt else ""))), F.lit(8))))
        won = cut(tried.join(used, [*within, "id"], "left_anti").groupBy(*within, "id").agg(F.min(name).alias(name)).select(*own, "id"))
        left = cut(left.join(won, own, "left_anti"))
        out, used, salt = won if out is None else out.unionByName(won), used.unionByName(won.select(*within, "id")), salt + 1
    return out if out is not None else left.withColumn("id", F.lit(None).cast("string"))


def numbered(rows: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """``rows`` with a gapless number from 0 in the given order; equal rows in any.

    Rows are dealt into ranges and sorted there; a range's first number is the
    sum of the counts before it, so no task sees the whole table.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    own = cut(ranged.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    counts = own.groupBy("__part").agg(F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    place = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return own.join(starts, "__part").withColumn(name, place).drop("__at", "__part", "__start")


def chunks(rows: DataFrame, order: list[str], size: int = 30, step: int = 10, name: str = "row_number") -> DataFrame:
    """``rows`` numbered, once for each chunk of ``size`` rows that holds them; chunks begin every ``step`` rows."""
    own = numbered(rows, order, name)
    last = F.floor(F.col(name) / step)
    first = F.greatest(F.lit(0), F.ceil((F.col(name) - size + 1) / step))
    return own.withColumn("chunk", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
