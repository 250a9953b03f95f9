"""Near copies at a stated likeness: SimHash anchors and fingerprint bins bring texts together, the texts decide.

Two texts are linked where the Jaccard similarity of their sets of five-word
shingles is four fifths or more.  SimHash fingerprints of such pairs lie up to a
dozen bits apart, too far for any anchor code of bearable size.  So texts meet
that hang together by fingerprints within two bits, found by anchor-point
covering in full (``simhash.links``, five words: each at its nearest anchor and at
all within its own distance + 2), texts with one nearest anchor, and texts that
share a band of the bins of ``fingerprint.fingerprints``: 36 bands of seven
bins, 18 of neighbouring bins and 18 of bins 18 apart.  A pair at a similarity of
0.8 shares no band once in some 5,000, at 0.85 once in some 400,000; this is the
method's only loss.  Every pair is decided on the shingle sets, so none below
four fifths is ever linked.

A task compares the texts of one small group, or of two blocks of a large one,
all at once and hands on a spanning forest of its links, so copies never become
pairs.  In a large group all meet the group's first block (in a few of the
bands, as a family of near copies is together in most of them); then those that
are not yet connected with the group's largest part meet all its blocks.  So no
pair of a group is left out but those already connected, and a family of near
copies costs a few rows a text, however large it is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fingerprint, simhash
from .common import cut, spare, stored, text_or_empty
from .components import components, one_of_each

WORDS_PER_SHINGLE = 5
#: Least similarity of a link: shared shingles of all, as a fraction.
LIKE = (4, 5)
#: Bands of each of the two arrangements, and bins of a band.
BANDS, ROWS = 18, 7
#: Texts, and UTF-8 bytes, of a block on average; a smaller group is one block.
FEW, BYTES = 64, 1 << 22
#: Of the large groups' bands every so manyth is compared in the first step.
STEP = 9
#: Shingles put in one matrix.
COLUMNS = 1 << 14


def shingles(text: str | None) -> set[bytes]:
    """The five-word shingles: A-Z lower-cased, words parted by ASCII white space.

    Fewer words: the whole sequence is the only one.  No word, or null: none.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    k = min(WORDS_PER_SHINGLE, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def alike(a: set[bytes], b: set[bytes]) -> bool:
    """Whether the sets' Jaccard similarity reaches ``LIKE``; two empty sets are alike."""
    shared = len(a & b)
    return shared * LIKE[1] >= (len(a) + len(b) - shared) * LIKE[0]


def all_alike(sets: list[set[bytes]]) -> np.ndarray:
    """Matrix of ``alike`` of all pairs, from one product of the sets' incidence matrix."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    held = Counter(x for own in sets for x in own)
    number = {x: i for i, x in enumerate(x for x, n in held.items() if n > 1)}
    own = [np.sort(np.array([number[x] for x in s if x in number], dtype=np.int64)) for s in sets]
    shared = np.zeros((len(sets), len(sets)))
    for at in range(0, len(number), COLUMNS):
        has = np.zeros((len(sets), min(COLUMNS, len(number) - at)), dtype=np.float32)
        for i, x in enumerate(own):
            low, high = np.searchsorted(x, (at, at + COLUMNS))
            has[i, x[low:high] - at] = 1
        shared += has @ has.T
    np.fill_diagonal(shared, sizes)
    return shared * LIKE[1] >= (sizes[:, None] + sizes[None, :] - shared) * LIKE[0]


def _forest(keys: list[int], texts: list[str | None]) -> list[tuple[int, int]]:
    """Connects what hangs together among the texts: the least key of each part with all others."""
    sets = [shingles(x) for x in texts]
    if len(sets) == 2:
        return [(min(keys), max(keys))] if alike(*sets) else []
    near, left, out = all_alike(sets), set(range(len(keys))), []
    while left:
        part = ahead = [left.pop()]
        while ahead:
            ahead = [j for j in left if any(near[i, j] for i in ahead)]
            left.difference_update(ahead)
            part = part + ahead
        least, *others = sorted(keys[i] for i in part)
        out += [(least, x) for x in others]
    return out


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (group, key, text) sorted by group; a key may repeat within a group."""
    last, members = None, {}

    def links() -> pa.RecordBatch:
        got = _forest(list(members), list(members.values()))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in (0, 1)], names=["left", "right"])

    for batch in batches:
        for group, key, text in zip(*(c.to_pylist() for c in batch.columns)):
            if group != last:
                yield links()
                last, members = group, {}
            members[key] = text
    yield links()


def _linked(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """``left, right`` that connect alike members of each group of ``groups`` (group, key)."""
    met = groups.join(texts, "key").select("group", "key", "text").repartition("group").sortWithinPartitions("group")
    return cut(met.mapInArrow(_compared, "left long, right long"))


def _bands(bins: Column) -> Column:
    """Names of a text's bands: numbers and bins, hashed; of a text without words all say so."""
    runs = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, *[F.get(bins, b * ROWS + i) for i in range(ROWS)]))
    steps = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b + BANDS, *[F.get(bins, b + i * BANDS) for i in range(ROWS)]))
    return F.concat(runs, steps)


def _apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """The ``members`` (band, key) outside the largest connected part of their band, dealt into blocks."""
    roots = components(found, "left", "right").select(F.col("node").alias("key"), "root")
    own = cut(members.select("band", "key").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))
    parts = own.groupBy("band", "root").agg(F.count("*").alias("n"))
    largest = parts.groupBy("band").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    largest = largest.select("band", F.col("main.root").alias("main"), F.ceil((F.col("n") - F.col("main.n")) / FEW).alias("blocks"))
    apart = own.join(largest, "band").where("root != main")
    return cut(apart.select("band", "key", F.pmod(F.xxhash64("key", "band"), F.col("blocks")).alias("block")))


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """``group, key``: each block of ``right`` (band, block, key) with each block of ``left`` of its band."""
    a, b = (x.select("band", F.col("block").alias(n)).distinct() for x, n in ((left, "a"), (right, "b")))
    group = F.xxhash64("band", "a", "b").alias("group")
    lefts = left.withColumnRenamed("block", "a").join(b, "band").select(group, "key")
    rights = right.withColumnRenamed("block", "b").join(a, "band").select(group, "key")
    return lefts.unionByName(rights)


def links(texts: DataFrame) -> DataFrame:
    """``left, right`` that connect whatever alike rows of ``texts`` (key long, text) anchors and bands bring together."""
    told = cut(simhash.fingerprints(texts, "key", words_per_shingle=WORDS_PER_SHINGLE))
    # What the covering links is one group, whose texts are compared like a band's.
    covered = components(simhash.links(told), "left", "right").select(F.col("node").alias("fp"), "root")
    anchored = simhash.anchors(told).join(covered, "fp", "left").select(F.col("doc_id").alias("key"), F.array(F.xxhash64("anchor", F.lit("anchor")), F.xxhash64(F.coalesce("root", "fp"), F.lit("covered"))).alias("anchor"))
    named = fingerprint.fingerprints(texts.withColumn("key", F.struct("key", F.octet_length("text").alias("bytes"))), "key", words_per_shingle=WORDS_PER_SHINGLE)
    named = named.select("doc_id.*", _bands(F.col("bins")).alias("bands"))
    named = cut(named.join(anchored, "key"))
    members = named.select("key", "bytes", F.posexplode(F.concat("bands", "anchor")).alias("no", "band"))
    sizes = members.groupBy("band").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where("n > 1")
    blocks = F.ceil(F.greatest(F.col("n") / FEW, F.col("bytes") / BYTES)).cast("long")
    # Written as a table, so that Spark knows its size and chooses the join by it.
    members = cut(members.drop("bytes").join(stored(sizes.select("band", blocks.alias("blocks"))), "band"))
    small = members.where("blocks <= 1").groupBy("band").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    small = small.select("keys").distinct().select(F.xxhash64("keys").alias("group"), F.explode("keys").alias("key"))
    large = members.where("blocks > 1").select("no", "band", "key", F.pmod(F.xxhash64("key", "band"), F.col("blocks")).alias("block"))
    few = large.where(F.col("no") % STEP == 0)
    found = _linked(small.unionByName(_met(few.where("block = 0"), few)), texts)
    if large.isEmpty():
        return found
    return found.unionByName(_linked(_met(_apart(large, found), large), texts))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` of each group that hangs together by links: the one with the least id.

    Nulls come after all ids, and of one id the least text digest stays, then
    any one of equal rows.  Null text counts as empty; texts without words are
    alike.  Equal rows are near copies, too.  An empty table gives an empty one.
    """
    key = spare(df, "row_key")
    rows = stored(df.withColumn(key, F.monotonically_increasing_id()))
    texts = rows.select(F.col(key).alias("key"), text_or_empty(text_col).alias("text"))
    return one_of_each(rows, key, cut(components(links(texts), "left", "right")), id_col, text_col).select(*df.columns)
