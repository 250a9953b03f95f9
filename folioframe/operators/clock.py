"""One clock for all events: each time is the latest so far, each event has the next number.

The order of all rows is dealt in ranges; a range's own maxima and counts are
completed by those of the ranges before it, of which there is one row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def monotone(events: DataFrame, order: list[str], time: str, seq: str = "seq", clock: str = "clock", parts: int | None = None) -> DataFrame:
    """``events`` with ``seq`` (from 1, without a gap) and ``clock``, the greatest ``time`` up to and with the row.

    ``order`` must settle the order of all rows, null first; rows that it leaves
    equal come in any order.  A null time keeps the clock where it is.  The
    table is written out once, so that ranges, numbers and times are of the same rows.
    """
    spark = events.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(events.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    per = dealt.groupBy("__part").agg(F.count("*").alias("n"), F.max(time).alias("most"))
    # One row a range: the only window without a key, over as many rows as there are ranges.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"), F.max("most").over(before).alias("__most"))
    own = Window.partitionBy("__part").orderBy(*order)
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = dealt.withColumn("__nth", F.row_number().over(own)).withColumn("__max", F.max(time).over(so_far)).join(F.broadcast(starts), "__part")
    return told.select(*events.columns, (F.col("__before") + F.col("__nth")).alias(seq), F.greatest("__max", "__most").alias(clock))
