"""A running roll-up of diagnostic events from a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """``window_start, event_type, n``: events of each type per window, late ones up to ``late`` counted."""
    counted = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n")


# The levels of events, the least first.
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR")


def at_least(events: DataFrame, level: str) -> DataFrame:
    """Events of this ``level`` and above, streams too; a level that is none of the four counts as the lowest."""
    place = F.greatest(F.lit(1), F.array_position(F.array(*map(F.lit, LEVELS)), F.coalesce("level", F.lit(""))))
    return events.where(place > LEVELS.index(level))


def phase_times(events: DataFrame) -> DataFrame:
    """``run, phase, started, finished, seconds, n, status`` of phases: ``failed`` with an event at ERROR, else ``done``.

    ``events``: ``run, phase, at`` (seconds), ``level``.
    """
    per = events.groupBy("run", "phase").agg(F.min("at").alias("started"), F.max("at").alias("finished"), F.count("*").alias("n"), F.count_if(F.coalesce(F.col("level") == "ERROR", F.lit(False))).alias("errors"))
    return per.select("run", "phase", "started", "finished", (F.col("finished") - F.col("started")).alias("seconds"), "n", F.when(F.col("errors") > 0, "failed").otherwise("done").alias("status"))
