"""Collocations: frequent phrases of two to four words, scored by their weakest cut.

A phrase can be frequent only if each of its words is.  So the words of each
group are counted first, the frequent ones numbered, and pieces broken at all
others.  Texts become blocks of local word numbers once; a block's own word list
(and not its texts) meets the dictionary, so the dictionary is never shipped
whole to a worker.  The n-grams of a block are packed into fixed-width binary
keys of four 32-bit ids, radix-sorted and run-length counted before they leave
the task; ranges of keys, cut at splitters from a bounded sample of blocks, then
get the same sort and count.  Splitters only balance the work: any of them give
the same counts.  All tables between the steps lie in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Words of the texts packed into one block, at least (the last piece may pass it).
BLOCK_WORDS = 300_000
#: N-grams that a task holds before it sorts and hands them on.
HELD_GRAMS = 3_000_000
#: N-grams aimed at per range; beyond ``MOST_RANGES`` ranges each is split by a hash of the key.
RANGE_GRAMS = 1_000_000
MOST_RANGES = 20_000
#: Expected blocks that the splitters are drawn from, and the step between the keys taken of each.
SAMPLE_BLOCKS, SAMPLE_STEP = 64, 500
#: Parts of a group that are ranked by themselves first.
TOP_PARTS = 32
#: Longest phrase, as a key holds four ids.
LONGEST = 4

_DELIMITERS = b".,;:!?\n\x0b\x0c\r"
#: A-Z lower-cased, every piece delimiter a full stop.
_TABLE = bytes(ord(".") if b in _DELIMITERS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _squeezed(rows: np.ndarray) -> bytes:
    """The rows of a byte matrix, all first bytes, all second ones and so on, compressed."""
    return pa.compress(np.ascontiguousarray(rows.T).tobytes(), codec="zstd", asbytes=True)


def _spread_out(packed: bytes, width: int, n: int) -> np.ndarray:
    """The inverse of ``_squeezed`` for ``n`` rows of ``width`` bytes."""
    return np.frombuffer(pa.decompress(packed, width * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(width, n).T


class _Words(dict):
    """word -> its number within the block, from 1 in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return len(self) - 1


class _Block:
    """The texts of one group, as numbers of its own word list; 0 breaks a piece."""

    def __init__(self):
        self.words, self.numbers = _Words({b".": 0}), []

    def add(self, text: str) -> int:
        numbers = [self.words[w] for w in text.encode().translate(_TABLE).replace(b".", b" . ").split()]
        self.numbers.append(np.array([*numbers, 0], dtype=np.uint32))
        return len(numbers) + 1

    def row(self, group: str) -> tuple:
        numbers = np.concatenate(self.numbers)
        return group, [*self.words][1:], np.bincount(numbers, minlength=len(self.words))[1:], len(numbers), _squeezed(numbers.view(np.uint8).reshape(-1, 4))


def _pack(least: int):
    """Map function: ``group`` and ``text`` become blocks of ``least`` words, the last ones of a task fewer."""
    names = ["group", "words", "counts", "size", "numbers"]

    def flush(open_blocks):
        for group, block in open_blocks.items():
            group, words, counts, size, numbers = block.row(group)
            listed = pa.ListArray.from_arrays([0, len(words)], pa.array(words, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([group]), listed, pa.ListArray.from_arrays([0, len(words)], pa.array(counts, pa.int64())), pa.array([size], pa.int64()), pa.array([numbers], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks, held = {}, 0
        for batch in batches:
            for group, text in zip(*batch.columns):
                held += open_blocks.setdefault(group.as_py(), _Block()).add(text.as_py())
                if held >= least:
                    yield from flush(open_blocks)
                    open_blocks, held = {}, 0
        yield from flush(open_blocks)

    return run


def blocks(docs: DataFrame, group_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``block, group, words, counts, size, numbers``: the table in blocks, each with its own word list (a null group is ``und``, null text empty)."""
    own = docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit("und")).alias("group"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    packed = own.mapInArrow(_pack(BLOCK_WORDS), "`group` string, words array<string>, counts array<long>, size long, numbers binary")
    return packed.select(F.monotonically_increasing_id().alias("block"), "*")


def _word_rows(packed: DataFrame) -> DataFrame:
    """One row per block and word; ``pos`` is the word's number in the block."""
    each = packed.select("block", "group", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "word"))
    return each.select("block", "group", (F.col("pos") + 1).alias("pos"), F.col("word.words").alias("word"), F.col("word.counts").alias("n"))


def dictionary(packed: DataFrame, least: int) -> DataFrame:
    """``group, word, f, id``: the words with at least ``least`` occurrences in their group, numbered from 1 without a gap.

    A row's place in its partition plus the rows of the partitions before it, so
    no task sees all words; what the driver holds is a number a partition.
    """
    counted = _word_rows(packed).groupBy("group", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    rows = stored(counted.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("at", 33)
    sizes = sorted(tuple(r) for r in rows.groupBy(part.alias("part")).count().collect())
    starts = np.cumsum([0, *[n for _, n in sizes]])
    if starts[-1] >= 1 << 32:
        raise ValueError(f"{starts[-1]} frequent words, a key's id has 32 bits")
    start = F.element_at(F.create_map(*[F.lit(int(x)) for (p, _), s in zip(sizes, starts) for x in (p, s)]), part) if sizes else F.lit(0)
    return rows.select("group", "word", "f", (start + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("id"))


def _with_ids(packed: DataFrame, words: DataFrame) -> DataFrame:
    """``size, numbers, ids``: each block with the dictionary's ids of its words (number and id in one long)."""
    met = _word_rows(packed).join(words.select("group", "word", "id"), ["group", "word"])
    ids = met.groupBy("block").agg(F.collect_list(F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("id"))).alias("ids"))
    return packed.select("block", "size", "numbers").join(ids, "block").select("size", "numbers", "ids")


def _sequences(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The ids in the order of each block's texts, 0 for a break."""
    for size, own, told in zip(*batch.columns):
        told = told.values.to_numpy().astype(np.uint64)
        local = np.ascontiguousarray(_spread_out(own.as_buffer(), 4, size.as_py())).view(np.uint32).ravel()
        table = np.zeros(int(local.max()) + 1, dtype=np.uint64)
        table[told >> np.uint64(32)] = told & np.uint64(0xFFFFFFFF)
        yield table[local]


def _grams(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys (upper and lower half) of all phrases of 2 to ``LONGEST`` frequent words, unused places zero."""
    upper, lower = [], []
    whole = seq != 0
    for n in range(2, LONGEST + 1):
        whole = whole[:-1] & (seq[n - 1 :] != 0) if len(whole) else whole
        at = np.flatnonzero(whole)
        ids = [seq[at + i] if i < n else np.uint64(0) for i in range(LONGEST)]
        upper.append(ids[0] << np.uint64(32) | ids[1])
        lower.append(np.broadcast_to(ids[2] << np.uint64(32) | ids[3], at.shape))
    return np.concatenate(upper), np.concatenate(lower)


def radix_order(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Places in ascending order of the key: eight stable passes over 16-bit digits, those that are all alike left out."""
    order = np.arange(len(upper))
    for half in (lower, upper):
        for shift in (0, 16, 32, 48):
            digit = (half >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(upper: np.ndarray, lower: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in ascending order and how often (or with what total weight) each occurs."""
    order = radix_order(upper, lower)
    upper, lower = upper[order], lower[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (upper[1:] != upper[:-1]) | (lower[1:] != lower[:-1])
    at = np.flatnonzero(fresh)
    if weights is None:
        return upper[at], lower[at], np.diff(np.append(at, len(order)))
    return upper[at], lower[at], np.add.reduceat(weights[order], at) if len(at) else np.zeros(0, dtype=np.int64)


def _bytes(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Keys as 16 bytes a row, big-endian, so that byte order is key order."""
    return np.column_stack([upper, lower]).astype(">u8").view(np.uint8).reshape(-1, 16)


def _halves(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(keys).view(">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _thin(step: int):
    """Map function: every ``step``-th distinct key of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq in _sequences(batch):
                upper, lower, _ = run_lengths(*_grams(seq))
                keys = _bytes(upper[::step], lower[::step])
                yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary())], names=["key"])

    return run


def _splitters(packed: DataFrame, words: DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that begin all ranges but the first, from the sampled blocks' keys."""
    share = min(1.0, SAMPLE_BLOCKS / max(1, packed.count()))
    keys = sorted(r.key for r in _with_ids(packed.sample(share, seed=1), words).mapInArrow(_thin(SAMPLE_STEP), "key binary").collect()) if ranges > 1 else []
    chosen = sorted({bytes(keys[len(keys) * i // ranges]) for i in range(1, ranges)}) if keys else []
    return _halves(np.frombuffer(b"".join(chosen), dtype=np.uint8))


def _spread(splitters: tuple[np.ndarray, np.ndarray], buckets: int, most: int):
    """Map function: n-grams of the blocks, ``most`` at a time run-length counted, one row per range and bucket.

    A row's keys and counts are squeezed; sorted keys pack well.
    """

    def cuts(upper, lower):
        out = []
        for u, w in zip(*splitters):
            a, b = np.searchsorted(upper, [u, u + np.uint64(1)])
            out.append(a + np.searchsorted(lower[a:b], w))
        return [0, *out, len(upper)]

    def rows(held):
        upper, lower = (np.concatenate(x) for x in zip(*held))
        held.clear()
        upper, lower, counts = run_lengths(upper, lower)
        bounds, made = cuts(upper, lower), []
        bucket = ((upper * np.uint64(0x9E3779B97F4A7C15) ^ lower) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(33)) % np.uint64(buckets)
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            for k in np.unique(bucket[a:b]) if buckets > 1 else range(int(b > a)):
                at = a + np.flatnonzero(bucket[a:b] == k) if buckets > 1 else slice(a, b)
                made.append((i, int(k), len(upper[at]), _squeezed(_bytes(upper[at], lower[at])), _squeezed(counts[at].astype(np.uint32).view(np.uint8).reshape(-1, 4))))
        columns = zip(*made) if made else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["range", "bucket", "size", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for seq in _sequences(batch):
                held.append(_grams(seq))
                n += len(held[-1][0])
                if n >= most:
                    yield from rows(held)
                    n = 0
        if n:
            yield from rows(held)

    return run


def _counted(least: int):
    """Group function: the keys of one range and bucket that occur ``least`` times or more, unused places cut off."""

    def run(table: pa.Table) -> pa.Table:
        sizes = table["size"].to_pylist()
        keys, counts = (np.concatenate([_spread_out(x.as_buffer(), width, n) for x, n in zip(table[c], sizes)]) for c, width in (("keys", 16), ("counts", 4)))
        counts = np.ascontiguousarray(counts).view(np.uint32).ravel().astype(np.int64)
        upper, lower, f = run_lengths(*_halves(keys), counts)
        often = f >= least
        lower = lower[often]
        places = 2 + (lower != 0).astype(int) + ((lower & np.uint64(0xFFFFFFFF)) != 0)
        grams = [k.tobytes()[: 4 * n] for k, n in zip(_bytes(upper[often], lower), places)]
        return pa.table({"gram": pa.array(grams, pa.binary()), "f": pa.array(f[often], pa.int64())})

    return run


def frequent_grams(packed: DataFrame, words: DataFrame, least: int, total: int) -> DataFrame:
    """``gram, f``: all phrases of 2 to 4 words with ``least`` occurrences or more, as big-endian 4-byte ids.

    ``total`` is the number of occurrences of frequent words; it sets the number of ranges.
    """
    wanted = -(-total * (LONGEST - 1) // RANGE_GRAMS)
    ranges = max(1, min(MOST_RANGES, wanted))
    spread = _spread(_splitters(packed, words, ranges), max(1, -(-wanted // ranges)), HELD_GRAMS)
    rows = _with_ids(packed, words).mapInArrow(spread, "`range` int, bucket int, size long, keys binary, counts binary")
    return rows.groupBy("range", "bucket").applyInArrow(_counted(least), "gram binary, f long")


def dice(a: Column, left: Column, right: Column) -> Column:
    """``floor(2000000 a / (left + right))``, exact where the product passes 64 bits."""
    wide = [x.cast("decimal(20,0)") for x in (a, left, right)]
    return F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * wide[0], wide[1] + wide[2])


def _cut_scores(grams: DataFrame, parts: DataFrame) -> DataFrame:
    """``gram, a, l, r, score`` by each phrase's lowest-scoring cut, ties to the shortest first part."""
    n = F.expr("cast(length(gram) div 4 as int)")
    cuts = grams.select("gram", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("substring(gram, 1, 4 * k)").alias("first"), F.expr("substring(gram, 4 * k + 1)").alias("rest"))
    met = cuts.join(parts.select(F.col("gram").alias("first"), F.col("f").alias("l")), "first").join(parts.select(F.col("gram").alias("rest"), F.col("f").alias("r")), "rest")
    lowest = met.groupBy("gram").agg(F.min(F.struct(dice(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r", "a")).alias("cut"))
    return lowest.select("gram", "cut.a", "cut.l", "cut.r", "cut.score")


def _longest_host(grams: DataFrame) -> DataFrame:
    """``gram, host``: for each phrase inside a longer one, the most occurrences of such a longer one."""
    n = F.expr("cast(length(gram) div 4 as int)")
    spans = F.expr("transform(sequence(2, cast(length(gram) div 4 as int) - 1), m -> transform(sequence(0, cast(length(gram) div 4 as int) - m), s -> substring(gram, 4 * s + 1, 4 * m)))")
    inner = grams.where(n > 2).select(F.explode(F.flatten(spans)).alias("gram"), "f")
    return inner.groupBy("gram").agg(F.max("f").alias("host"))


def collocations(docs: DataFrame, group_col: str = "lang", text_col: str = "text", least: int = 30, top: int | None = 2000, host_percent: int = 80) -> DataFrame:
    """``group, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each group (None: all).

    Texts are lower-cased in A-Z, cut into pieces at ``. , ; : ! ?`` and line
    ends and those into words at spaces and tabs; phrases lie within a piece,
    overlapping ones all count.  ``a`` is a phrase's count (``least`` or more),
    ``l`` and ``r`` those of its parts at the cut with the lowest ``dice``, ``n``
    all words of the group.  A phrase goes that lies inside a longer frequent one
    with at least ``host_percent`` in a hundred of its count.  Order: score and
    ``a`` descending, phrase ascending by its UTF-8 bytes.

    A null group is the group ``und``, null text empty.  Repeated rows count
    again, other columns play no part, an empty table gives an empty result.
    """
    packed = stored(blocks(docs, group_col, text_col))
    words = stored(dictionary(packed, least))
    total = words.agg(F.sum("f")).first()[0] or 0
    grams = stored(frequent_grams(packed, words, least, total))
    # The four low bytes of the id, most significant first, as in a key.
    single = words.select(F.expr("unhex(lpad(hex(id), 8, '0'))").alias("gram"), "f")
    parts = single.unionByName(grams.where(F.length("gram") < 4 * LONGEST))
    hosts = _longest_host(grams)
    inside = F.col("host").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * host_percent
    scored = _cut_scores(grams, parts).join(hosts, "gram", "left").where(~F.coalesce(inside, F.lit(False)))
    named = scored.select("gram", F.posexplode(F.expr("transform(sequence(0, cast(length(gram) div 4 as int) - 1), i -> cast(conv(hex(substring(gram, 4 * i + 1, 4)), 16, 10) as long))")).alias("pos", "id"))
    spelled = named.join(words.select("id", "group", "word"), "id").groupBy("gram").agg(F.first("group").alias("group"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    sizes = _word_rows(packed).groupBy("group").agg(F.sum("n").alias("n"))
    rows = scored.join(spelled, "gram").join(sizes, "group")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:
        # The first of each part of a group before the first of the group, so that no task meets all of one.
        part = F.row_number().over(Window.partitionBy("group", "part").orderBy(*order))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(TOP_PARTS))).withColumn("rank", part).where(F.col("rank") <= top)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(*order)).cast("long"))
    return (ranked.where(F.col("rank") <= top) if top is not None else ranked).select("group", "rank", "phrase", "a", "l", "r", "n", "score")
