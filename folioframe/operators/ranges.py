"""Positions within ranges, overlapping ones too, as an equality join on bins.

Ranges are unfolded into the bins that they touch, within the least and the
greatest position of their key; a position has one bin.  The exact bounds are
tested on what meets.  However long a range is, its work lies in as many groups
as it touches bins, and a bin holds few positions on average.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions that a bin should hold on average, and bins unfolded from one row at a time.
ROWS_PER_BIN, BINS_AT_ONCE = 256, 4096


def _bin(at: Column, width: int) -> Column:
    """The number of a position's bin, rounded down below zero, too."""
    return F.call_function("div", at - F.pmod(at, F.lit(width)), F.lit(width))


def contained(positions: DataFrame, ranges: DataFrame, on: list[str], at: str, start: str, end: str, width: int | None = None) -> DataFrame:
    """All columns of ``positions`` and of ``ranges`` (but ``on``), a row for each position and range with ``start <= at < end``.

    ``at``, ``start`` and ``end`` are whole numbers; ``on`` names the columns
    that must be equal.  ``width`` is a bin's length (None: by the data, in one
    job).  A null key, position or bound meets nothing, nor does a range that
    ends at its start or before; repeated rows meet each by itself.  The two
    tables share no column name but ``on``.
    """
    extent = positions.where(F.col(at).isNotNull()).groupBy(*on).agg(F.min(at).alias("__low"), F.max(at).alias("__high"), F.count("*").alias("__n"))
    if width is None:
        length, n = extent.agg(F.sum((F.col("__high") - F.col("__low") + 1).cast("decimal(38,0)")), F.sum("__n")).first()
        width = max(1, -(-int(length or 1) * ROWS_PER_BIN // int(n or 1)))
    low, high = F.greatest(F.col(start).cast("long"), F.col("__low")), F.least(F.col(end).cast("long") - 1, F.col("__high"))
    met = ranges.join(extent.drop("__n"), on).where((F.col(start) < F.col(end)) & (low <= high)).select(*ranges.columns, _bin(low, width).alias("__first"), _bin(high, width).alias("__last"))
    # In two steps, so that no row holds the list of all bins of a long range.
    stretch = F.explode(F.expr(f"sequence(__first div {BINS_AT_ONCE} - 1, __last div {BINS_AT_ONCE} + 1)"))
    parts = met.withColumn("__part", stretch).withColumn("__from", F.expr(f"greatest(__first, __part * {BINS_AT_ONCE})")).withColumn("__to", F.expr(f"least(__last, __part * {BINS_AT_ONCE} + {BINS_AT_ONCE - 1})"))
    binned = parts.where("__from <= __to").withColumn("__bin", F.explode(F.sequence("__from", "__to"))).select(*ranges.columns, "__bin")
    placed = positions.withColumn("__bin", _bin(F.col(at).cast("long"), width))
    inside = (F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))
    return placed.join(binned, [*on, "__bin"]).where(inside).drop("__bin")


def flagged(positions: DataFrame, ranges: DataFrame, on: list[str], at: str, start: str, end: str, flag: str) -> DataFrame:
    """``positions`` with the boolean ``flag``: whether any range holds the row's position (false where key or position is null)."""
    spots = positions.select(*on, at).distinct()
    held = contained(spots, ranges.select(*on, F.col(start).alias("__start"), F.col(end).alias("__end")), on, at, "__start", "__end").select(*on, at).distinct()
    return positions.join(held.withColumn(flag, F.lit(True)), [*on, at], "left").select(*positions.columns, F.coalesce(flag, F.lit(False)).alias(flag))
