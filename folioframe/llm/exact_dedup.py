"""Exact deduplication by deterministic block naming.

Every text is cut into fixed-size blocks.  The distinct blocks, sorted, get
integer names; then adjacent names are paired and the distinct pairs, sorted,
named again, until each document is one symbol.  Two documents have the same
(level, name) exactly when their texts are identical: names stand for contents
and not for hashes of them.

Shuffles: block contents move once, pre-aggregated, to be made distinct and
named.  A block's occurrences then find the name by the 64-bit address of the
block; addresses that two different blocks share are set apart and named by
content, so an address only routes and never decides.  Later levels move
integers only.  A block that a third of all documents hold is one row per task
in the first shuffle; its occurrences are split by the adaptive skew join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spare, text_or_empty

#: Bytes of a block.
BLOCK_BYTES = 1024


def _blocks(text: Column) -> Column:
    """Array of the text's blocks, in order; the empty text is one empty block."""
    raw = F.encode(text, "UTF-8")
    last = F.greatest(F.lit(0), F.floor((F.octet_length(text) - 1) / BLOCK_BYTES)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * BLOCK_BYTES + 1, F.lit(BLOCK_BYTES)))


def _ranked(distinct: DataFrame, *keys: str) -> DataFrame:
    """Adds ``name``: the partition's number and the key's rank within it."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _first_names(rows: DataFrame, address) -> DataFrame:
    """Level 0: ``doc_id, text_sha256, n, pos, name`` of every block of every row."""
    blocks = rows.select("doc_id", "text_sha256", F.posexplode(_blocks(F.col("text"))).alias("pos", "block"), F.octet_length("text").alias("bytes"))
    blocks = blocks.select("doc_id", "text_sha256", F.greatest(F.lit(1), F.ceil(F.col("bytes") / BLOCK_BYTES)).alias("n"), "pos", address(F.col("block")).alias("address"), "block")
    names = cut(_ranked(blocks.select("address", "block").distinct(), "block").select("address", "name"))
    shared = cut(names.groupBy("address").count().where("count > 1").select("address"))
    if shared.isEmpty():
        return blocks.drop("block").join(names, "address").drop("address")
    alone = blocks.drop("block").join(names.join(shared, "address", "left_anti"), "address").drop("address")
    twins = blocks.join(shared, "address", "left_semi").drop("address")
    by_content = _ranked(twins.select("block").distinct(), "block").withColumn("name", -1 - F.col("name"))
    return alone.unionByName(twins.join(cut(by_content), "block").drop("block"))


def identities(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", address=F.xxhash64) -> DataFrame:
    """``doc_id, text_sha256, level, name, copies``: one row per (id, text).

    (level, name) is the text's identity.  Null text counts as empty; ids may
    be null or repeat.  ``copies`` counts rows that repeat both id and text.
    The digest only keeps texts apart that share one id.
    """
    text = text_or_empty(text_col)
    rows = df.select(F.col(id_col).alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), text.alias("text"))
    symbols = cut(_first_names(rows, address)).withColumn("copies", F.lit(1).cast("long"))
    most = symbols.agg(F.max("n")).first()[0] or 1
    levels = [symbols.where("n = 1").withColumn("level", F.lit(0))]
    for level in range(1, (most - 1).bit_length() + 1):
        right = F.col("pos") % 2 == 1
        pairs = cut(
            symbols.where("n > 1")
            .groupBy("doc_id", "text_sha256", F.ceil(F.col("n") / 2).alias("n"), F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(F.max(F.when(~right, F.col("name"))).alias("left"), F.max(F.when(right, F.col("name"))).alias("right"), F.sum(F.when(~right, F.col("copies"))).alias("copies"))
            .withColumn("alone", F.col("right").isNull())
            .na.fill({"right": 0})
        )
        names = cut(_ranked(pairs.select("left", "right", "alone").distinct(), "left", "right", "alone"))
        symbols = pairs.join(names, ["left", "right", "alone"]).drop("left", "right", "alone")
        levels.append(symbols.where("n = 1").withColumn("level", F.lit(level)))
    keys = ["doc_id", "text_sha256", "level", "name"]
    return reduce(DataFrame.unionByName, [x.select(*keys, "copies") for x in levels]).groupBy(*keys).agg(F.sum("copies").alias("copies"))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays; a null id stays only
    where its group has no other.  Of rows that repeat both id and text one is
    ``kept``.  Null text counts as empty.  An empty table gives an empty result.
    """
    own = cut(identities(df, id_col, text_col))
    # Materialised, so that the join deals both sides anew and a hot group's rows can be split.
    groups = cut(own.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")))
    joined = own.join(groups, ["level", "name"])
    each = joined.select("doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that ``exact_duplicates`` keeps.

    Rows that repeat both id and text come back once.
    """
    sha, keep_id, keep_sha = (spare(df, n) for n in ("sha", "keep_id", "keep_sha"))
    kept = exact_duplicates(df, id_col, text_col).where("kept").select(F.col("doc_id").alias(keep_id), F.col("text_sha256").alias(keep_sha))
    marked = df.withColumn(sha, F.sha2(text_or_empty(text_col).cast("binary"), 256))
    once = marked.dropDuplicates([id_col, sha]) if _repeats(marked, id_col) else marked
    return once.join(kept, F.col(id_col).eqNullSafe(F.col(keep_id)) & (F.col(sha) == F.col(keep_sha)), "left_semi").drop(sha)


def _repeats(df: DataFrame, id_col: str) -> bool:
    """Whether some id occurs twice (ids only are read)."""
    return not df.groupBy(id_col).count().where("count > 1").isEmpty()
