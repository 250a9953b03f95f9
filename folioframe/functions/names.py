"""Names of files that are made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each mode puts behind a name, and the longest name in UTF-16 units.
SUFFIXES = {"format_only": "_FORMATTED.docx", "convert": "_CANADIAN_FORMATTED.docx"}
LONGEST = 240


def utf16_units(text: Column) -> Column:
    return (F.length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def shortened(text: Column, units: Column) -> Column:
    """The longest beginning of whole code points that fits ``units``."""
    fits = F.filter(F.sequence(F.floor(units / 2), units.cast("long")), lambda n: utf16_units(F.left(text, n.cast("int"))) <= units)
    return F.left(text, F.array_max(fits).cast("int"))


def bounded(stem: Column, suffix: str) -> Column:
    """``stem`` and ``suffix``; where that is too long a digest of it stands for the stem's end."""
    whole = F.concat(stem, F.lit(suffix))
    tail = F.concat(F.lit("__"), F.left(F.sha2(whole, 256), F.lit(12)), F.lit(suffix))
    return F.when(utf16_units(whole) <= LONGEST, whole).otherwise(F.concat(shortened(stem, F.lit(LONGEST) - utf16_units(tail)), tail))


def output_names(files: DataFrame, mode: str = "format_only") -> DataFrame:
    """``files`` with ``output_name``, from their ``path``.

    A stem that several files have, letters folded, gets its folder's name and
    a digest of the path.  A null path has a null name.  Stems are counted by a
    grouping and joined back, so a stem of very many files is split as any
    skewed join is.
    """
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    folder = F.regexp_extract("path", r"([^/\\]*)[/\\][^/\\]*$", 1)
    safe = F.regexp_replace(F.regexp_replace(folder, "[^A-Za-z0-9_-]+", "-"), "^[-_]+|[-_]+$", "")
    safe = F.when(safe == "", "source").otherwise(F.left(safe, F.lit(32)))
    own = files.withColumn("__stem", F.regexp_replace(name, r"(?<=.)[.][^.]+$", ""))
    shared = own.groupBy(F.lower("__stem").alias("__folded")).agg(F.count("*").alias("__n")).where("__n > 1")
    joined = own.join(shared, F.lower("__stem") == F.col("__folded"), "left")
    stem = F.when(F.col("__n").isNull(), F.col("__stem")).otherwise(F.concat("__stem", F.lit("__"), safe, F.lit("-"), F.left(F.sha1(F.col("path")), F.lit(8))))
    return joined.withColumn("output_name", bounded(stem, SUFFIXES[mode])).drop("__stem", "__folded", "__n")


def name_collisions(named: DataFrame, output_folder: str) -> DataFrame:
    """``name, n, code``: names given twice (``shared``, letters folded) and files that an output would overwrite (``input``)."""
    folded = F.lower("output_name").alias("name")
    twice = named.groupBy(folded).agg(F.count("*").alias("n")).where("n > 1").withColumn("code", F.lit("shared"))
    there = named.select(F.lower("path").alias("__path")).distinct()
    made = named.select(folded, F.lower(F.concat(F.lit(output_folder.rstrip("/") + "/"), "output_name")).alias("__path"))
    over = made.join(there, "__path", "left_semi").groupBy("name").agg(F.count("*").alias("n")).withColumn("code", F.lit("input"))
    return twice.unionByName(over)
