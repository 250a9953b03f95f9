"""Which files a run takes, and why it leaves the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names

# Beginnings of lock files, and the ends of names that a run gives to what it makes.
LOCK, OWN_ENDS = "~$", tuple(sorted(s.lower() for s in names.SUFFIXES.values()))


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def _key(path: Column) -> Column:
    """One form for all ways to write a path: scheme, repeated slashes and ``/./`` left out."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:/*(?=/)", ""), r"/(?:[.]/)+|//+", "/")
    return F.regexp_replace(bare, r"^(.)/$", "$1")


def chosen(candidates: DataFrame, excluded: str | None = None) -> DataFrame:
    """``path, given, code, place``: what becomes of each of ``candidates`` (path, given: named itself and not found in a folder).

    ``code`` is null for files that are taken, in the order of ``place`` (name
    with letters folded, then path, from 1); else ``no_path``,
    ``not_a_docx``, ``lock_file``, ``own_output``, ``excluded`` (the last three
    for files found in a folder only; a named one is taken, or told by
    ``template`` if it is the ``excluded`` one) or ``repeated`` (the path again,
    after one that was named).
    """
    name, key = F.lower(_name(F.col("path"))), _key(F.col("path"))
    own = F.lit(False)
    for end in OWN_ENDS:
        own = own | name.endswith(end)
    out = F.lit(False) if excluded is None else key == _key(F.lit(excluded))
    found = ~F.coalesce("given", F.lit(False))
    code = (
        F.when(F.col("path").isNull() | (name == ""), "no_path").when(~name.endswith(".docx"), "not_a_docx").when(found & name.startswith(LOCK), "lock_file").when(found & own, "own_output")
        .when(found & out, "excluded").when(out, "template")
    )
    told = candidates.select("path", F.coalesce("given", F.lit(False)).alias("given"), key.alias("__key"), code.alias("code"))
    again = F.row_number().over(Window.partitionBy("__key", F.col("code").isNull()).orderBy(F.desc("given"), "path"))
    told = told.withColumn("code", F.coalesce("code", F.when(again > 1, "repeated")))
    taken = told.where("code IS NULL").select("path", "given", "code", F.lower(_name(F.col("path"))).alias("__name"))
    # Files of one listing: as many as a run's folders hold.
    placed = taken.withColumn("place", F.row_number().over(Window.orderBy("__name", "path"))).drop("__name")
    return placed.unionByName(told.where("code IS NOT NULL").select("path", "given", "code", F.lit(None).cast("int").alias("place")))


def collected(spark: SparkSession, folders: list[str], files: list[str] = (), excluded: str | None = None) -> DataFrame:
    """``chosen`` of all files right in the ``folders`` and of the named ``files``; a named one that isn't there has the code ``missing``."""
    found = None
    for folder in folders:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", "*").load(folder).select("path", F.lit(False).alias("given"))
        found = listed if found is None else found.unionByName(listed)
    named = spark.createDataFrame([(f, True) for f in files], "path string, given boolean")
    told = chosen(named if found is None else found.unionByName(named), excluded)
    there = None
    for file in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            there = [*(there or []), file]
    if not there:
        return told
    gone = F.col("given") & F.col("path").isin(*there)
    return told.withColumn("code", F.when(gone, "missing").otherwise(F.col("code"))).withColumn("place", F.when(~gone, F.col("place")))
