"""Files read while nobody writes them: two listings around the read, compared by path.

A file counts as read only if length, time and digest are the same before and
after, and the bytes that were read have that digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut


def listing(spark: SparkSession, folder: str, glob: str = "*.docx") -> DataFrame:
    """``path, modified, length, sha256`` of the folder's own files as they are now."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(folder)
    return cut(found.select("path", F.col("modificationTime").alias("modified"), "length", F.sha2("content", 256).alias("sha256")))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, fault``: ``vanished``, ``appeared``, ``resized``, ``rewritten`` (other bytes) or ``touched`` (other time) between two listings.

    The first of these that holds; a path twice in a listing counts once, with
    its greatest time.  No rows: nothing changed.
    """
    told = lambda df, name: df.groupBy("path").agg(F.max(F.struct("modified", "length", "sha256")).alias(name))
    both = told(before, "b").join(told(after, "a"), "path", "full_outer")
    fault = (
        F.when(F.col("a").isNull(), "vanished").when(F.col("b").isNull(), "appeared").when(~F.col("a.length").eqNullSafe(F.col("b.length")), "resized")
        .when(~F.col("a.sha256").eqNullSafe(F.col("b.sha256")), "rewritten").when(~F.col("a.modified").eqNullSafe(F.col("b.modified")), "touched")
    )
    return both.select("path", fault.alias("fault")).where("fault IS NOT NULL")


def steady_files(spark: SparkSession, folder: str, glob: str = "*.docx", during=None) -> DataFrame:
    """``path, content, sha256, fault``: the folder's files, with no content where one changed while it was read.

    ``during`` (for tests) is called between the read and the second listing.
    What is read is written to the checkpoint folder first, so no later use of
    the rows opens a file again.
    """
    before = listing(spark, folder, glob)
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(folder)
    read = cut(found.select("path", "content", F.sha2("content", 256).alias("sha256")))
    if during:
        during()
    moved = changes(before, listing(spark, folder, glob))
    checked = read.join(before.select("path", F.col("sha256").alias("told")), "path", "full_outer").join(moved, "path", "full_outer")
    fault = F.coalesce("fault", F.when(F.col("sha256").isNull() | F.col("told").isNull() | (F.col("sha256") != F.col("told")), "rewritten"))
    return checked.select("path", F.when(fault.isNull(), F.col("content")).alias("content"), F.when(fault.isNull(), F.col("sha256")).alias("sha256"), fault.alias("fault"))
