"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Shards stand on a ring at many virtual nodes.  A document's hash falls into a
cell of the ring; its home is the first shard clockwise.  Every shard takes
floor(n / shards) documents, the first n mod shards one more.  What overflows a
full shard continues clockwise to the next shard that it has not asked, so
counts differ by one at most and only the overflow moves from its home.

A round places all that the shards asked have room for, in the order of a hash;
a shard that turns anything away is full for good, so there are at most as many
rounds as shards.  Places are ranks within a shard: counts per hash slice,
summed up, plus a rank inside the slice.  No task sorts a whole shard.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

#: Virtual nodes of a shard, and cells of the ring.
VIRTUAL_NODES = 64
CELLS = 4096
#: Documents of one shard that a task ranks together.
SLICE_ROWS = 2048


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> list[list[int]]:
    """For each cell, all shards in the order in which they come clockwise."""
    at: dict[int, list[int]] = {}
    for shard in range(shards):
        place = random.Random(f"shard {shard}")
        for _ in range(virtual_nodes):
            at.setdefault(place.randrange(cells), []).append(shard)
    orders: list[list[int]] = [[]] * cells
    order: list[int] = []
    for cell in range(2 * cells - 1, -1, -1):  # backwards, twice round, the nearest shard moves to the front
        here = sorted(set(at.get(cell % cells, [])))
        order = here + [s for s in order if s not in here]
        if cell < cells:
            orders[cell] = order
    return orders


def _preferences(shards: int) -> Column:
    """Array of the cells' shard orders, as one constant."""
    text = "[" + ",".join(str(x) for x in ring(shards)).replace(" ", "") + "]"
    return F.from_json(F.lit(text), "array<array<int>>")


def _ranked(rows: DataFrame, slices: int) -> DataFrame:
    """Adds ``rank``, from 0, of each row within its ``shard`` by ``order``."""
    width = (1 << 63) // slices + 1
    sliced = rows.withColumn("slice", F.floor(F.shiftrightunsigned("order", 1) / F.lit(float(width))).cast("long"))
    counts = sliced.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    lower = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "slice", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "slice").orderBy("order", "doc_id", "size", "text_crc32", "copy")
    return sliced.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["shard", "slice"]).withColumn("rank", F.col("rank") + F.col("start")).drop("slice", "start")


def assign(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, shard, slot``.

    ``size`` is the text's UTF-8 bytes plus 1, ``slot`` numbers a shard's rows
    from 0 without gaps.  Null text counts as empty, a null id hashes as such;
    repeated rows are separate documents.  Counts of any two shards differ by at
    most one.  Reruns agree: hashes of id, text and shard number decide.
    Equal texts may go to different shards; this law has no place for groups.
    """
    text = text_or_empty(text_col)
    own = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    folded = own.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    each = folded.select("doc_id", "size", "text_crc32", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    each = each.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).cast("int")).withColumn("order", F.xxhash64("doc_id", "size", "text_crc32", "copy", F.lit("order")))
    waiting = cut(each)
    total = waiting.count()
    room = {s: total // shards + (s < total % shards) for s in range(shards)}
    filled = dict.fromkeys(room, 0)
    orders, done, count = _preferences(shards), [], total
    for ask in range(shards):
        asked = waiting.withColumn("shard", F.get(F.get(orders, F.col("cell")), F.lit(ask)))
        ranked = _ranked(asked, max(1, count // (shards * SLICE_ROWS)))
        table = F.create_map(*[F.lit(x) for s in room for x in (s, room[s] - filled[s])])
        used = F.create_map(*[F.lit(x) for s in room for x in (s, filled[s])])
        placed = cut(ranked.withColumn("fits", F.col("rank") < table[F.col("shard")]).withColumn("slot", F.col("rank") + used[F.col("shard")]))
        done.append(placed.where("fits"))
        counts = {r["shard"]: r["n"] for r in placed.where("fits").groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row a shard
        for s, n in counts.items():
            filled[s] += n
        waiting = placed.where("not fits").drop("shard", "rank", "fits", "slot")
        count = total - sum(filled.values())
        if not count:
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
