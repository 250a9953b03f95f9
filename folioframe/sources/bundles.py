"""Artifacts written as one directory that appears whole or not at all.

Tasks write into a staging directory beside the place of the bundle; what lies
there is read again and held against its manifest, and one rename publishes it.
The manifest (a row an artifact: owner, id, media type, length, digest) is a
table of its own in the directory.  A directory's default name is a digest of
all its artifacts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import snapshots

# The manifest's format, and how names of artifacts are written.
FORMAT, VERSION = "folioframe-bundle", 1
SAFE_ID = "^[a-z0-9][a-z0-9_.-]{0,99}$"

MANIFEST = "format string, version int, owner string, artifact string, media_type string, length long, sha256 string, required boolean"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _held(artifacts: DataFrame) -> DataFrame:
    return artifacts.select(F.col("owner").cast("string").alias("owner"), "artifact", "media_type", "content")


def manifest_of(artifacts: DataFrame, required: list[str] | None = None) -> DataFrame:
    """The manifest of ``artifacts`` (owner, artifact, media_type, content binary); null content is empty."""
    content = F.coalesce("content", F.lit(b""))
    wanted = F.col("artifact").isin(*required) if required else F.lit(False)
    return _held(artifacts).select(F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), "owner", "artifact", "media_type", F.octet_length(content).cast("long").alias("length"), F.sha2(content, 256).alias("sha256"), wanted.alias("required"))


def faults(manifest: DataFrame, artifacts: DataFrame, required: list[str] | None = None) -> DataFrame:
    """``owner, artifact, fault``: everything that is wrong between a manifest and the artifacts it stands for.

    ``format``, ``unsafe_id``, ``listed_twice``, ``held_twice``, ``missing``
    (listed, not held), ``unlisted`` (held, not listed), ``length``, ``digest``,
    and ``required`` for owners that lack one of the ``required`` ids (in the
    manifest, whose own flag must say so, too).  No rows: sound.
    """
    told = manifest.withColumn("owner", F.col("owner").cast("string"))
    key = ["owner", "artifact"]
    named = F.coalesce(F.col("artifact").rlike(SAFE_ID), F.lit(False))
    own = told.select(*key, F.explode(F.array_compact(F.array(F.when(~((F.col("format") == FORMAT) & (F.col("version") == VERSION)) | F.col("format").isNull() | F.col("version").isNull(), "format"), F.when(~named, "unsafe_id")))).alias("fault"))
    listed = told.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("length", "sha256", "required")).alias("m"))
    content = F.coalesce("content", F.lit(b""))
    held = _held(artifacts).select(*key, F.octet_length(content).cast("long").alias("length"), F.sha2(content, 256).alias("sha256")).groupBy(*key).agg(F.count("*").alias("n_held"), F.min(F.struct("length", "sha256")).alias("h"))
    # Null names are no names of anything: they are told above, and never met here.
    both = listed.join(held, key, "full_outer")
    wrong = F.array_compact(
        F.array(
            F.when(F.col("n") > 1, "listed_twice"), F.when(F.col("n_held") > 1, "held_twice"), F.when(F.col("n_held").isNull(), "missing"), F.when(F.col("n").isNull(), "unlisted"),
            F.when((F.col("n") == 1) & (F.col("n_held") == 1) & ~F.col("m.length").eqNullSafe(F.col("h.length")), "length"),
            F.when((F.col("n") == 1) & (F.col("n_held") == 1) & F.col("m.length").eqNullSafe(F.col("h.length")) & ~F.col("m.sha256").eqNullSafe(F.col("h.sha256")), "digest"),
        )
    )
    found = own.unionByName(both.select(*key, F.explode(wrong).alias("fault")))
    if not required:
        return found
    have = listed.where("m.required").groupBy("owner").agg(F.collect_set("artifact").alias("have"))
    asked = told.select("owner").distinct().join(have, "owner", "left").select("owner", F.explode(F.array_except(F.array(*map(F.lit, required)), F.coalesce("have", F.array().cast("array<string>")))).alias("artifact"))
    return found.unionByName(asked.select("owner", "artifact", F.lit("required").alias("fault")))


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Manifest and artifacts of a directory; a manifest line that isn't of its schema is an error."""
    manifest = spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(f"{folder}/manifest")
    return manifest, spark.read.parquet(f"{folder}/artifacts")


def stage(artifacts: DataFrame, root: str, required: list[str] | None = None) -> str:
    """Writes artifacts and manifest to a new staging directory under ``root`` and returns its path.

    The manifest is made of what was written.  A fault removes the directory
    and raises ValueError with the first twenty.
    """
    spark = artifacts.sparkSession
    folder = f"{root.rstrip('/')}/.staging-{uuid.uuid4().hex}"
    try:
        _held(artifacts).write.parquet(f"{folder}/artifacts")
        manifest_of(spark.read.parquet(f"{folder}/artifacts"), required).write.json(f"{folder}/manifest")
        _demand_sound(spark, folder, required)
    except BaseException:
        discard(spark, folder)
        raise
    return folder


def _demand_sound(spark: SparkSession, folder: str, required: list[str] | None) -> None:
    wrong = faults(*read(spark, folder), required).orderBy("owner", "artifact", "fault").limit(20).collect()
    if wrong:
        raise ValueError("; ".join(f"{r.owner}/{r.artifact}: {r.fault}" for r in wrong))


def name_of(spark: SparkSession, folder: str) -> str:
    """A directory name by the content: the same artifacts have the same, in whatever order or files they lie."""
    manifest, _ = read(spark, folder)
    one = manifest.select(F.lit("all").alias("k"), F.to_json(F.struct("owner", "artifact", "media_type", "sha256")).alias("a"))
    got = snapshots.digests(one, ["k"], F.col("a"), F.lit("")).first()
    return got.digest[:32] if got else "0" * 32


def publish(spark: SparkSession, staged: str, name: str | None = None, overwrite: bool = False, required: list[str] | None = None) -> str:
    """Renames a staging directory to ``name`` beside it, after another look at it, and returns the new path.

    A directory of that name stays, and the call fails, unless ``overwrite``;
    then it is set aside first, put back if the rename fails, else removed.
    """
    root, _, last = staged.rpartition("/")
    if not last.startswith(".staging-"):
        raise ValueError(f"{staged} is no staging directory")
    _demand_sound(spark, staged, required)
    target = f"{root}/{name or name_of(spark, staged)}"
    fs, place = _file_system(spark, target)
    there, aside = _file_system(spark, staged)[1], _file_system(spark, f"{root}/.replaced-{uuid.uuid4().hex}")[1]
    if fs.exists(place):
        if not overwrite:
            raise FileExistsError(target)
        if not fs.rename(place, aside):
            raise OSError(f"{target} can't be set aside")
    if not fs.rename(there, place):
        if fs.exists(aside):
            fs.rename(aside, place)
        raise OSError(f"{staged} can't be renamed to {target}")
    if fs.exists(aside):
        fs.delete(aside, True)
    return target


def discard(spark: SparkSession, staged: str) -> None:
    """Removes a staging directory; anything else is refused."""
    if not staged.rpartition("/")[2].startswith(".staging-"):
        raise ValueError(f"{staged} is no staging directory")
    fs, place = _file_system(spark, staged)
    fs.delete(place, True)
