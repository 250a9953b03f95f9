"""SimHash near-duplicates by anchor-point covering.

A fingerprint is 64 bits, each the majority of that bit over the hashes of the
text's word shingles.  To find all pairs within ``threshold`` bits, a covering
code supplies anchors: here the words of two perfect Golay codes side by side
over 46 of the bits, so every fingerprint has one nearest anchor, at most 6
away.  Say x is the one of a pair that is nearer to its anchor: then x's
partner y lies within (y's own distance + threshold) of that anchor.  So every
fingerprint is put once at its nearest anchor and replicated to each anchor
within its own distance + threshold (69 rows on average, a constant of the
code), and the join on the anchor compares what meets there.  No pair within
the threshold is lost; one that meets is checked on all 64 bits.

Equal fingerprints are folded before, so copies cost nothing, and a
fingerprint has at most 2,080 others within two bits: links grow with the
number of different fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, per_text, spare, stored
from .components import components, one_of_each

#: Bits in which linked fingerprints may differ.
THRESHOLD = 2
#: Hashes added up in one numpy pass.
CHUNK = 1 << 15


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """SimHash of a whole text, as a signed 64-bit integer.

    A-Z are lower-cased, words are parted by ASCII white space, shingles are
    hashed with XXH64 (seed 42), repeats included.  Fewer words than a shingle:
    the whole sequence is the only one.  No word, or null: zero.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[: len(words) - k + 1].tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts)).view(">i8")[0])


# The perfect binary Golay code: 23 bits, 12 of them free, every word within 3
# of exactly one code word.  Generator polynomial (fixed value):
_GOLAY = 0b101011100011
_BITS = 23


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator polynomial: 11 bits."""
    left = words.astype(np.int64)
    for bit in range(_BITS - 1, 10, -1):
        left = np.where(left >> bit & 1, left ^ (_GOLAY << (bit - 11)), left)
    return left


@lru_cache(maxsize=4)
def _errors(extra: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Per syndrome: the least weight, and the patterns up to ``extra`` heavier with their excess."""
    patterns = np.array([sum(1 << b for b in bits) for w in range(3 + extra + 1) for bits in combinations(range(_BITS), w)])
    weights = np.array([bin(p).count("1") for p in patterns])
    syndromes = _syndrome(patterns)
    least = np.full(2048, 99)
    np.minimum.at(least, syndromes, weights)
    excess = weights - least[syndromes]
    order = np.lexsort((patterns, excess, syndromes))
    order = order[excess[order] <= extra]
    split = np.searchsorted(syndromes[order], np.arange(1, 2048))
    return least, np.split(patterns[order], split), np.split(excess[order], split)


def _placed(threshold: int | None):
    """Rows (fp, anchor): the nearest anchor (None), or all within a fingerprint's own distance + threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, patterns, excess = _errors(threshold or 0)
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                fps = whole.column(0).slice(at, 2_000).to_numpy()
                low, high = fps & (1 << _BITS) - 1, fps >> _BITS & (1 << _BITS) - 1
                found = []
                for x, y, a, b in zip(low, high, _syndrome(low), _syndrome(high)):
                    words = (x ^ patterns[a])[:, None] | ((y ^ patterns[b])[None, :] << _BITS)
                    found.append(words[excess[a][:, None] + excess[b][None, :] <= (threshold or 0)])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fps, [len(x) for x in found])), pa.array(np.concatenate(found))], names=["fp", "anchor"])

    return run


def links(fingerprints: DataFrame, fp_col: str = "fp", threshold: int = THRESHOLD) -> DataFrame:
    """``left, right``: all pairs of different fingerprints within ``threshold`` bits, once each.

    ``fp_col`` holds 64-bit integers; repeats and nulls are folded away.
    """
    own = fingerprints.where(F.col(fp_col).isNotNull()).select(F.col(fp_col).cast("long").alias("fp")).distinct()
    # Dealt by number: so few bytes would else be merged into a task or two before each row becomes 69.
    own = own.repartition(int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    homes = own.mapInArrow(_placed(None), "fp long, anchor long").select("anchor", F.col("fp").alias("x"))
    others = own.mapInArrow(_placed(threshold), "fp long, anchor long").select("anchor", F.col("fp").alias("y"))
    apart = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    # Sorted and merged: Spark takes the replicated rows for as few as the fingerprints and would send them whole through the driver.
    met = homes.join(others.hint("merge"), (homes.anchor == others.anchor) & (F.col("x") != F.col("y")) & (apart <= threshold))
    return met.select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right")).distinct()


def anchors(fingerprints: DataFrame, fp_col: str = "fp") -> DataFrame:
    """The columns of ``fingerprints`` and ``anchor``, the code's anchor nearest to the 64-bit ``fp_col`` (null: null)."""
    own = fingerprints.where(F.col(fp_col).isNotNull()).select(F.col(fp_col).cast("long").alias("fp")).distinct()
    homes = own.mapInArrow(_placed(None), "fp long, anchor long")
    return fingerprints.join(homes.withColumnRenamed("fp", "own_fp"), F.col(fp_col) == F.col("own_fp"), "left").drop("own_fp")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (signed 64-bit) of every row's whole text."""
    own = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return per_text(own, "text", ("doc_id",), [("fp", "long", pa.int64())], lambda text: (fingerprint(text, words_per_shingle),))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    ``fingerprint`` is 16 lowercase hex digits.  ``component_id`` is the least
    doc_id reachable over links of at most ``threshold`` differing bits, the
    row's own included; null only where a component has no id.  Null, empty and
    blank texts have fingerprint zero and link like any other.  Repeated rows
    come back repeated.
    """
    own = cut(fingerprints(df, id_col, text_col, words_per_shingle))
    first = own.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(own, "fp", threshold), "left", "right")
    rooted = first.join(roots, first.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("own_fp"), "component_id")
    return own.join(named, own.fp == F.col("own_fp")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """One row of ``df`` of each component: the one with the least id, nulls after all ids.

    Of one id the least text digest stays, then any one of equal rows, so that
    repeated ids and rows without one leave one row of a component, too.
    """
    key = spare(df, "row_key")
    rows = stored(df.withColumn(key, F.monotonically_increasing_id()))
    own = cut(near_duplicates(rows, key, text_col, words_per_shingle, threshold))
    return one_of_each(rows, key, own.select(F.col("doc_id").alias("node"), F.col("component_id").alias("root")), id_col, text_col).select(*df.columns)
