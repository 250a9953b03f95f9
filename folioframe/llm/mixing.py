"""Mixing sources to target weights by the cube method.

A source's target is its weight's share of all words, at most ``cap`` times
what it has, the excess shared again by weight.  Each document of a source is
taken floor(target / size) times for certain and once more with the fractional
rest as its inclusion probability.  The cube method decides these rests: the
vector of probabilities moves along the null space of the constraints (words
taken, documents taken) until each coordinate is 0 or 1, so both totals stay
where they are, up to the last few documents of a source.

The flight runs in blocks: documents are dealt to blocks of bounded size by a
hash, each block leaves at most two undecided, and those are dealt to blocks
again until one block a source is left, which lands by giving up the document
count first and the words last, and then turns over at most two documents to
take back the words by which the last one missed.  A hot source is just more blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, spare, text_or_empty

#: A source's target is at most so many times its size.
CAP = 3
#: Documents that one flight moves at a time.
BLOCK_ROWS = 1024
#: Tables with one row a source are broadcast up to so many rows.
BROADCAST_SOURCES = 10_000
#: Weights by the sources' code point order, repeating, null last.
WEIGHTS = (1, 2, 3)

_EPS = 1e-9


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size, target`` from ``source, size``: one row a source.

    Weights go by code point order of the name, null last.  If every source has
    size zero all targets are zero.  Windows here run over sources, one row each.
    """
    per = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    # The sources that reach their cap are those of the least size per weight.
    weighed = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)).withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
    rising = Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = rising.rowsBetween(0, Window.unboundedFollowing)
    filled = (
        weighed.withColumn("all", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("level", (F.col("all") - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(rest))
        .withColumn("free", F.col("level") <= F.col("ratio"))
    )
    shared = filled.withColumn("shared", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ever = F.max(F.col("free")).over(before)
    target = F.when(F.col("free") | F.coalesce(ever, F.lit(False)), F.least(F.col("weight") * F.col("shared"), cap * F.col("source_size").cast("double"))).otherwise(cap * F.col("source_size").cast("double"))
    return shared.select("source", "source_size", target.alias("target"))


def _flight(p: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> None:
    """Moves ``p`` in place until fewer coordinates than constraints + 1 are fractional.

    ``rows``: constraints x documents.  Works on constraints + 1 coordinates at
    a time, so a block costs time in proportion to its documents.
    """
    width = len(rows) + 1
    waiting = iter(np.nonzero((p > _EPS) & (p < 1 - _EPS))[0].tolist())
    window: list[int] = []
    while True:
        while len(window) < width and (nxt := next(waiting, None)) is not None:
            window.append(nxt)
        if len(window) < width:
            return
        a = rows[:, window]
        if width == 3:
            u = np.array([a[0, 1] * a[1, 2] - a[0, 2] * a[1, 1], a[0, 2] * a[1, 0] - a[0, 0] * a[1, 2], a[0, 0] * a[1, 1] - a[0, 1] * a[1, 0]])
        else:
            u = np.array([a[0, 1], -a[0, 0]])
        if not u.any():  # three documents of one size: any two can trade
            u = np.array([1.0, -1.0, 0.0])
        q = p[window]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min()
            down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)).min()
        q = q + up * u if rng.random() * (up + down) < down else q - down * u
        q[q < _EPS], q[q > 1 - _EPS] = 0.0, 1.0
        p[window] = q
        window = [i for i in window if 0 < p[i] < 1]


def _settle(p: np.ndarray, size: np.ndarray, aim: float) -> None:
    """Turns over the one or two documents, if any, that bring the words nearest to ``aim``.

    The last document to land may be a large one; this takes its error back.
    """
    change = np.where(p > 0.5, -size, size)
    order = np.argsort(change, kind="stable")
    want = aim - float(p @ size)
    best, turned = abs(want), []
    at = np.searchsorted(change[order], want - change)
    for step in (-1, 0):
        k = order[np.clip(at + step, 0, len(order) - 1)]
        miss = np.where(k == np.arange(len(p)), np.inf, np.abs(change + change[k] - want))
        i = int(miss.argmin())
        if miss[i] < best - 0.5:
            best, turned = float(miss[i]), [i, int(k[i])]
    i = int(np.abs(change - want).argmin())
    if abs(change[i] - want) <= best and abs(change[i] - want) < abs(want) - 0.5:
        turned = [i]
    p[turned] = 1 - p[turned]


def _block(key: tuple, rows: pd.DataFrame, land: bool, seed: int) -> pd.DataFrame:
    # Large documents first: what stays undecided, and may miss the target, is small.
    rows = rows.assign(least=-rows["size"]).sort_values(["least", "order", "doc_id", "size", "copy"], kind="stable")
    rng = np.random.default_rng([seed, *(int(k) & 0xFFFFFFFF for k in key)])
    p, size = rows["p"].to_numpy(dtype=float, copy=True), rows["size"].to_numpy(dtype=float)
    aim = float(p @ size)
    _flight(p, np.vstack([size, np.ones(len(p))]), rng)
    if land:
        _flight(p, size[None, :], rng)
        left = (p > 0) & (p < 1)
        p[left] = (rng.random(int(left.sum())) < p[left]).astype(float)
        _settle(p, size, aim)
    return rows.assign(p=p)


def _mover(level: int, seed: int, names: list[str]):
    def move(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sid, block, land = (int(x) for x in key)
        return _block((sid, sid >> 32, block, level), rows, bool(land), seed)[names]

    return move


def _small(per_source: DataFrame) -> DataFrame:
    """With a broadcast hint where its rows are few; else a plain join is left to Spark."""
    return F.broadcast(per_source) if per_source.count() <= BROADCAST_SOURCES else per_source


def _decided(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 0) -> DataFrame:
    """As ``mix``, with ``copy``: the number of a row among those of the same id, source and size."""
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    id_type = df.schema[id_col].dataType
    own = cut(df.select(F.col(id_col).cast("string").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")))
    aims = _small(cut(targets(own, weights, cap).withColumn("sid", F.xxhash64("source", F.lit(seed)))))
    # Repeated rows are numbered after folding, so that equal ones can be dealt apart.
    folded = own.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    each = folded.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    rate = F.when(F.col("source_size") == 0, 0.0).otherwise(F.col("target") / F.col("source_size"))
    whole = F.floor(rate + 1e-12)
    aimed = each.join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    state = aimed.withColumn("whole", whole).withColumn("p", F.when(F.col("size") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), rate - whole)))
    state = cut(state.withColumn("p", F.when(F.col("p") < _EPS, 0.0).otherwise(F.col("p"))).withColumn("order", F.xxhash64("doc_id", "size", "copy", F.lit(seed))))
    schema, done, level = state.schema, [], 0
    while True:
        done.append(state.where("p = 0 or p = 1"))
        open_rows = state.where("p > 0 and p < 1")
        counts = _small(cut(open_rows.groupBy("sid").agg(F.count("*").alias("rows"))))
        most = counts.agg(F.max("rows")).first()[0] or 0
        if not most:
            break
        blocks = F.ceil(F.col("rows") / BLOCK_ROWS)
        dealt = open_rows.join(counts, "sid").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("order", F.lit(level)), "blocks"))
        last = F.col("blocks") == 1

        state = cut(dealt.withColumn("land", last).groupBy("sid", "block", "land").applyInPandas(_mover(level, seed, schema.names), schema))
        level += 1
    result = done[0]
    for x in done[1:]:
        result = result.unionByName(x)
    copies = (F.col("whole") + F.col("p")).cast("long")
    return result.select(F.col("doc_id").cast(id_type).alias("doc_id"), "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "copy")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 0) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, taken, copies``.

    ``size`` is the number of words (null text: 0), ``taken`` is size x
    ``copies``, 0 <= copies <= cap.  Words taken of a source differ from its
    target by a few words where two documents in its last block can make
    them up, and never by more than its largest document; the expected copies of a
    document are target / source_size.  Reruns give the same rows: every draw
    comes from ``seed`` and the documents themselves.  Null source is a source
    of its own, repeated rows are separate documents, an empty table gives an
    empty result, and a source without words takes nothing.
    """
    return _decided(df, id_col, text_col, source_col, weights, cap, seed).drop("copy")


def apply_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 0) -> DataFrame:
    """The rows of ``df``, all columns, each as often as the mix takes it."""
    size, copy, times = (spare(df, n) for n in ("own_size", "own_copy", "times"))
    of_id, of_source, of_size, of_copy = (spare(df, f"took_{n}") for n in ("id", "source", "size", "copy"))
    took = cut(_decided(df, id_col, text_col, source_col, weights, cap, seed).where("copies > 0"))
    took = took.select(F.col("doc_id").alias(of_id), F.col("source").alias(of_source), F.col("size").alias(of_size), F.col("copy").alias(of_copy), F.col("copies").alias(times))
    sized = df.withColumn(size, F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long"))
    if df.groupBy(id_col).count().where("count > 1").isEmpty():
        sized = sized.withColumn(copy, F.lit(1).cast("long"))
    else:  # rows that repeat id, source and size are told apart by their order
        sized = sized.withColumn(copy, F.row_number().over(Window.partitionBy(id_col, source_col, size).orderBy(text_col)).cast("long"))
    same = F.col(id_col).eqNullSafe(F.col(of_id)) & F.col(source_col).eqNullSafe(F.col(of_source)) & (F.col(size) == F.col(of_size)) & (F.col(copy) == F.col(of_copy))
    every = spare(df, "every")
    return sized.join(took, same).withColumn(every, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*df.columns)
