"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each word shingle is hashed once.  The hash's high bits say its bin, the least
hash of a bin is the bin's value.  An empty bin takes over the value of another
that is drawn uniformly from the filled ones: the first filled one in the empty
bin's own fixed permutation of all bins (optimal densification).  Only the low
eight bits of each value are kept, two hex digits a bin.  Two different values
share their low bits by chance once in 256, which the likeness takes back.

A text's fingerprint needs that text only.  For the next document's text, rows
are dealt once into ranges of ids; each range also gets a copy of the first row
of the range after it.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import SPACE, bind, cut, text_or_empty

BINS_BITS = 7
BINS = 1 << BINS_BITS
#: Low-order bits kept of a bin's value.
VALUE_BITS = 8
WORDS_PER_SHINGLE = 5
#: Ranges of ids for each shuffle partition.
RANGES_PER_PARTITION = 4


def _shingles(text: Column, k: int) -> Column:
    """Hashes of the text's k-word shingles; of the whole sequence if it is shorter; none without words."""
    words = F.transform(F.filter(F.split(F.lower(text), SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))

    def of(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return F.when(F.size(w) >= k, each).when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>"))

    return bind(words, of)


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BINS_BITS).cast("int")


def _minima(hashes: Column) -> Column:
    """Array of every bin's least hash, in a fixed order of bins, null where a bin is empty.

    One top value per bin joins the hashes before they are sorted, so that the
    first of each bin is its minimum or, in an empty bin, that top value.
    """
    high, low = 64 - BINS_BITS, (1 << (64 - BINS_BITS)) - 1
    tops = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("long"), high).bitwiseOR(F.lit(low)))
    ordered = F.sort_array(F.concat(hashes, tops))
    firsts = bind(ordered, lambda s: F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))))
    return F.transform(firsts, lambda x: F.when(x.bitwiseAND(F.lit(low)) != low, x))


def _permutations(seed: int = 1) -> Column:
    """For each bin all other bins in an order of its own (a constant of the method)."""
    orders = []
    for b in range(BINS):
        other = [x for x in range(BINS) if x != b]
        random.Random(f"{seed}/{b}").shuffle(other)
        orders.append(",".join(map(str, other)))
    return F.from_json(F.lit("[" + ",".join(f"[{x}]" for x in orders) + "]"), "array<array<int>>")


def _densified(minima: Column, orders: Column) -> Column:
    def of(m: Column) -> Column:
        def taken(order: Column, start: int, n: int) -> Column:
            return F.get(F.filter(F.transform(F.slice(order, start, n), lambda b: F.get(m, b)), lambda x: x.isNotNull()), F.lit(0))

        def full(x: Column, i: Column) -> Column:
            order = F.get(orders, i)
            return F.coalesce(x, taken(order, 1, 4), taken(order, 5, 16), taken(order, 21, BINS))

        return F.when(F.exists(m, lambda x: x.isNotNull()), F.transform(m, full)).otherwise(F.array().cast("array<bigint>"))

    return bind(minima, of)


def values(text: Column, orders: Column, k: int = WORDS_PER_SHINGLE) -> Column:
    """Array of the low-order bits of all bins; empty for a text without words."""
    return F.transform(_densified(_minima(_shingles(text, k)), orders), lambda x: x.bitwiseAND(F.lit((1 << VALUE_BITS) - 1)).cast("int"))


def packed(bins: Column) -> Column:
    """The bins as lowercase hex, two digits each ("" for a text without words)."""
    return F.array_join(F.transform(bins, lambda x: F.lpad(F.lower(F.hex(x)), VALUE_BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of shingles that two texts have in common, from their bins.

    1 for two texts without words, 0 if one has words.  The share of equal bins
    is corrected for chance and kept within 0 and 1.
    """
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    chance = 2.0**-VALUE_BITS
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = WORDS_PER_SHINGLE) -> DataFrame:
    """``doc_id, bins array<int>, fingerprint`` of every row; null text counts as empty.

    Equal texts have equal fingerprints; letters count as lower case and words are parted by ASCII white space.
    """
    own = df.select(F.col(id_col).alias("doc_id"), values(text_or_empty(text_col), _permutations(), words_per_shingle).alias("bins"))
    return own.withColumn("fingerprint", packed(F.col("bins")))


def _place(rows: DataFrame) -> Column:
    """A number that never falls as ``doc_id`` rises: the id itself, or the first seven bytes of any other than a number."""
    if isinstance(rows.schema["doc_id"].dataType, NumericType):
        return F.col("doc_id")
    return F.conv(F.rpad(F.substring(F.hex(F.col("doc_id").cast("string")), 1, 14), 14, "0"), 16, 10).cast("long")


def _ranges(places: DataFrame, n: int) -> list:
    """At most ``n - 1`` places that cut the table into ranges of about equal rows."""
    at = [i / n for i in range(1, n)]
    got = places.agg(F.percentile_approx("place", F.array(*map(F.lit, at)), F.lit(100 * n)).alias("q")).first()[0] or []
    return sorted({x for x in got if x is not None})


def _range_of(bounds: list) -> Column:
    """The range's number by a balanced tree of comparisons; null ids come first."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("place") <= F.lit(bounds[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return F.when(F.col("place").isNull(), 0).otherwise(tree(0, len(bounds)))


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried=None) -> DataFrame:
    """``doc_id, text, next_text`` (and ``next_<carried>``): the document after each in ascending id.

    After the last comes the first.  Ids may be numbers or text.  Null ids come before all others; rows with
    one id follow each other by text.  Null text counts as empty.  A single row
    is its own next.  ``carried``: (name, function of the text column) computed
    once per text and handed on as well.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    n = RANGES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("place", _place(rows))
    bounds = _ranges(rows.select("place"), n)
    ranged = rows.withColumn("range", _range_of(bounds)).drop("place")
    # The least row of each range (ranges are as many as ``bounds``) goes to the range before it, too.
    least = ranged.groupBy("range").agg(F.min("doc_id").alias("first_id"), F.max(F.col("doc_id").isNull()).alias("has_null"))
    least = cut(least.withColumn("first_id", F.when(F.col("has_null"), None).otherwise(F.col("first_id"))))
    around = Window.orderBy("range")
    before = least.withColumn("to", F.coalesce(F.lag("range").over(around), F.max("range").over(Window.partitionBy()))).select(F.col("range").alias("r"), "first_id", "to")
    heads = ranged.join(F.broadcast(before), (ranged.range == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    heads = heads.groupBy("to", "doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", F.col("to").alias("range"), F.lit(1).alias("copy"))
    both = ranged.withColumn("copy", F.lit(0)).unionByName(heads)
    if carried:
        both = both.withColumn(carried[0], carried[1](F.col("text")))
    order = Window.partitionBy("range").orderBy("copy", F.asc_nulls_first("doc_id"), "text")
    out = both.withColumn("next_text", F.lead("text").over(order))
    if carried:
        out = out.withColumn(f"next_{carried[0]}", F.lead(carried[0]).over(order))
    return out.where("copy = 0").drop("copy", "range")


def edit_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of an edited form of it, and their likenesses.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.  The edited text has its last floor(n_chars / 2)
    code points replaced by the first as many (or all) of the next document.
    Null text counts as empty; the next of a row, also of a null or repeated id
    and of a single row, is as ``with_next`` says; an empty table gives an empty
    one.  Equal texts have equal fingerprints, texts without words the empty one.
    """
    orders = _permutations()
    told = with_next(df, id_col, text_col, ("bins", lambda text: values(text, orders)))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    told = told.withColumn("edited", edited).withColumn("edited_bins", values(F.col("edited"), orders))
    return told.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"),
        packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
