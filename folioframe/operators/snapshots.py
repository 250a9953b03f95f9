"""Digests of owners' parts, before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PIECES = range(1, 61, 15)


def digests(parts: DataFrame, owner: list[str], name: Column, content: Column) -> DataFrame:
    """``owner, n_parts, digest``: one digest for all parts of an owner, in any order.

    Each named part is hashed by itself; the digest is taken of the sums of the
    hashes' four pieces.  Sums are gathered before the shuffle and need no list,
    so an owner of very many parts is no burden.  Null content differs from
    empty content, equal parts count as often as they come.
    """
    own = F.sha2(F.concat(F.coalesce(name.cast("string"), F.lit("")), F.when(content.isNull(), F.lit("\x00")).otherwise(F.concat(F.lit("\x01"), content.cast("string")))), 256)
    hashed = parts.select(*owner, own.alias("__sha"))
    sums = [F.sum(F.conv(F.substring("__sha", at, 15), 16, 10).cast("decimal(20,0)").cast("decimal(28,0)")) for at in _PIECES]
    return hashed.groupBy(*owner).agg(F.count("*").alias("n_parts"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[s.cast("string") for s in sums]), 256).alias("digest"))


def changed_owners(before: DataFrame, after: DataFrame, owner: list[str]) -> DataFrame:
    """``owner, digest_before, digest_after`` of owners whose digests differ, null where a side has none; empty means unchanged."""
    b = before.select(*owner, F.col("digest").alias("digest_before"))
    a = after.select(*owner, F.col("digest").alias("digest_after"))
    return b.join(a, owner, "full_outer").where("NOT (digest_before <=> digest_after)")
