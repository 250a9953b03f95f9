"""Which tokens of two tokenizers stand for the same bytes of a text.

Both tokenizers cover the same bytes, a text with a space before it.  A common
cut is an offset where a token of each ends; common cuts split the tokens of a
text into groups.  Both tokenizers begin a new token at a space that follows
another character and precedes a word, so texts fall into fragments there that
are tokenized independently; those of a batch, without repeats, are aligned at
once with numpy: running sums of the token lengths give the ends, an
intersection the common cuts, a search the group of each token, repeats the
links.  A worker keeps the results of fragments in a memo bounded by bytes.
Links are counted over the corpus in two grouped sums, the first with a salt.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import _byte_letters
from .common import lone, pieces, spare, stored

#: Bytes of fragment results after which a worker's memo begins anew.
MEMO_BYTES = 96_000_000
#: Parts that the links of one id pair are first summed in.
SALTS = 16
#: Most id pairs that are broadcast (24 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 500_000

#: A space after another character and before printable ASCII or a letter: both tokenizers cut before it.
_CUT = re.compile("(?<=[^ ▁])(?= [!-~À-ÖØ-öø-ÿ])")
#: Fragments that begin and end so, with no other space, may stand side by side.
_PLAIN = re.compile("(?= [!-~À-ÖØ-öø-ÿ]).+[!-~À-ÖØ-öø-ÿ]", re.DOTALL)
#: Fragments encoded as one text.
JOINED_FRAGMENTS = 5000


def _lengths(token_bytes: dict[int, bytes]) -> np.ndarray:
    """The number of bytes of each id."""
    out = np.zeros(max(token_bytes) + 1, dtype=np.int64)
    out[list(token_bytes)] = [len(x) for x in token_bytes.values()]
    return out


class ByteBpe:
    """A byte-level BPE file of the tokenizers library; special tokens' strings count as plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        value = {letter: bytes([b]) for b, letter in enumerate(_byte_letters())}
        self.bytes = {i: b"".join([value.get(c, c.encode()) for c in token]) for token, i in vocab.items()}
        self.lengths = _lengths(self.bytes)

    def encode(self, fragments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, side by side, and each fragment's number of them.

        Fragments that begin and end plainly are encoded as one text, in which
        the next one's space is a cut; the others are encoded one by one.
        """
        joined = [i for i, x in enumerate(fragments) if _PLAIN.fullmatch(x)]
        alone = sorted(set(range(len(fragments))) - set(joined))
        parts, sizes = [], np.zeros(len(fragments), dtype=np.int64)
        for at in range(0, len(joined), JOINED_FRAGMENTS):
            own = joined[at : at + JOINED_FRAGMENTS]
            texts = [fragments[i] for i in own]
            ids = np.array(self.tokenizer.encode("".join(texts), add_special_tokens=False).ids, dtype=np.int64)
            ends, wanted = np.cumsum(self.lengths[ids]), np.cumsum([len(x.encode()) for x in texts])
            past = np.searchsorted(ends, wanted) + 1
            if (past > len(ends)).any() or (ends[past - 1] != wanted).any():
                raise ValueError("a token lies across two fragments")
            sizes[own] = np.diff(past, prepend=0)
            parts.append((own, ids))
        single = [self.tokenizer.encode(fragments[i], add_special_tokens=False).ids for i in alone]
        sizes[alone] = list(map(len, single))
        starts = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), dtype=np.int64)
        for own, ids in [*parts, (alone, np.fromiter(chain.from_iterable(single), dtype=np.int64))]:
            out[ranges(starts[own], sizes[own])] = ids
        return out, sizes


class PieceBpe:
    """A sentencepiece model with byte fallback, which writes U+2581 for a space and adds one in front."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())]
        self.bytes = {i: bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces}
        self.lengths = _lengths(self.bytes)

    def encode(self, fragments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, side by side, and each fragment's number of them; a fragment's first space is the one that the model adds."""
        parts = self.model.encode([x[1:] for x in fragments], num_threads=1)
        sizes = np.array(list(map(len, parts)), dtype=np.int64)
        return np.fromiter(chain.from_iterable(parts), dtype=np.int64, count=int(sizes.sum())), sizes


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[i] ... starts[i] + sizes[i] - 1`` for all i, one after the other, by repeats."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def align(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group of each A token and each B token, and the links, as places of A and B tokens that end together.

    Both sides have the same number of bytes.
    """
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    common = np.intersect1d(a_end, b_end, assume_unique=True)
    first, past = np.searchsorted(b_end, a_end, "left"), np.searchsorted(b_end, a_end, "right")
    return np.searchsorted(common, a_end), np.searchsorted(common, b_end), np.repeat(np.arange(len(a_end)), past - first), ranges(first, past - first)


class _Fragments:
    """Fragment results side by side in flat arrays: ids of either side, groups, links; a number a fragment."""

    NAMES = ("a", "b", "ga", "gb", "la", "lb")

    def __init__(self):
        self.number: dict[str, int] = {}
        self.parts: list[list[np.ndarray]] = [[] for _ in self.NAMES]
        self.sizes = {k: [] for k in ("a", "b", "groups", "links")}
        self.right: list[np.ndarray] = []
        self.texts: list[str] = []
        self.held = 0
        self._flat = None

    def add(self, fragments: list[str], one, other) -> None:
        """Encodes and aligns fragments that have no number yet."""
        (a, a_size), (b, b_size) = one.encode(fragments), other.encode(fragments)
        a_of, b_of = np.repeat(np.arange(len(fragments)), a_size), np.repeat(np.arange(len(fragments)), b_size)
        right = self._right(fragments, [(a, a_size, one), (b, b_size, other)])
        keep_a, keep_b = right[a_of], right[b_of]
        a, b, a_of, b_of = a[keep_a], b[keep_b], a_of[keep_a], b_of[keep_b]
        ga, gb, la, lb = align(one.lengths[a], other.lengths[b])
        count = lambda of: np.bincount(of, minlength=len(fragments))
        # A group ends with a token that is linked, so each fragment's groups are those of its last tokens.
        groups = np.zeros(len(fragments), dtype=np.int64)
        if len(ga):
            groups = np.bincount(a_of[np.flatnonzero(np.append(np.diff(ga) > 0, True))], minlength=len(fragments))
        base = len(self.number)
        self.number.update(zip(fragments, range(base, base + len(fragments))))
        before = np.cumsum(groups) - groups
        for held, new in zip(self.parts, (a, b, ga - before[a_of], gb - before[b_of], a[la], b[lb])):
            held.append(new.astype(np.int32))
        for k, v in zip(self.sizes, (count(a_of), count(b_of), groups, count(a_of[la]))):
            self.sizes[k].append(v.astype(np.int32))
        self.right.append(right)
        self.texts += self._written(a, b, ga, gb, groups)
        self.held += 16 * (len(a) + len(b) + len(la)) + sum(map(len, fragments)) * 6 + 300 * len(fragments)
        self._flat = None

    @staticmethod
    def _right(fragments: list[str], sides: list[tuple]) -> np.ndarray:
        """Whether both sides' tokens give back a fragment's bytes; looked at one by one only where the whole differs."""
        raw = [x.encode() for x in fragments]
        sizes = np.array(list(map(len, raw)), dtype=np.int64)
        right = np.ones(len(raw), dtype=bool)
        for ids, number, side in sides:
            told, ends = list(map(side.bytes.__getitem__, ids.tolist())), np.cumsum(number)
            total = np.append(0, np.cumsum(side.lengths[ids]))
            if (total[ends] - total[ends - number] != sizes).any() or b"".join(told) != b"".join(raw):
                right &= np.array([b"".join(told[e - n : e]) == x for e, n, x in zip(ends.tolist(), number.tolist(), raw)], dtype=bool)
        return right

    @staticmethod
    def _written(a, b, ga, gb, groups) -> list[str]:
        """Each fragment's groups as text: decimal ids of either side, ``a1,a2|b1;a3|b2``."""
        sides = []
        for ids, group in ((a, ga), (b, gb)):
            first = np.flatnonzero(np.diff(group, prepend=-1))
            past = np.append(first[1:], len(ids))
            words = list(map(str, ids.tolist()))
            said = list(map(words.__getitem__, first.tolist()))
            for g in np.flatnonzero(past - first > 1).tolist():
                said[g] = ",".join(words[first[g] : past[g]])
            sides.append(said)
        pairs, out, at = list(map("|".join, zip(*sides))), [], 0
        for n in groups.tolist():
            out.append(";".join(pairs[at : at + n]))
            at += n
        return out

    def flat(self):
        if self._flat is None:
            sizes = {k: np.concatenate(v) for k, v in self.sizes.items()}
            starts = {k: np.cumsum(v, dtype=np.int64) - v for k, v in sizes.items()}
            for k, v in sizes.items():
                self.sizes[k] = [v]
            for i, x in enumerate(self.parts):
                self.parts[i] = [np.concatenate(x)]
            self.right = [np.concatenate(self.right)]
            self._flat = dict(zip(self.NAMES, (x[0] for x in self.parts))), sizes, starts, self.right[0]
        return self._flat

    def gather(self, name: str, size: str, numbers: np.ndarray) -> np.ndarray:
        """The values of ``name`` of all these fragments in order."""
        arrays, sizes, starts, _ = self.flat()
        return arrays[name][ranges(starts[size][numbers], sizes[size][numbers])]


class Aligner:
    """Aligns texts of two tokenizers, ``one`` (A) and ``other`` (B)."""

    def __init__(self, one, other):
        self.one, self.other, self.memo = one, other, _Fragments()

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Of each text: its fragments' numbers (none where it has no tokens), with the memo that they refer to."""
        if self.memo.held > MEMO_BYTES:
            self.memo = _Fragments()
        split = [_CUT.split(" " + t) if t else [] for t in texts]
        known = self.memo.number
        new = [x for x in dict.fromkeys([x for s in split for x in s]) if x not in known]
        if new or not known:
            self.memo.add(new, self.one, self.other)
        right = self.memo.flat()[3]
        numbers = [np.array([known[x] for x in s], dtype=np.int64) for s in split]
        return [n if right[n].all() else n[:0] for n in numbers]


def _run(make: Callable, names: list[str], fields: dict[str, pa.DataType], rows: Callable):
    """Map function over kept columns and a text: ``rows`` gives the fields' columns for a batch's fragment numbers."""
    which = ("aligner", cloudpickle.dumps(make))  # a worker keeps the tokenizers and their memo from task to task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = lone(which, lambda: Aligner(*make()))
        for batch in chain.from_iterable(map(pieces, batches)):
            *kept, texts = batch.columns
            numbers = aligner.batch(texts.to_pylist())
            made = [pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(rows(aligner.memo, numbers), fields.values())]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*names, *fields])

    return run


def _lists(memo: _Fragments, numbers: list[np.ndarray], name: str, size: str, shift: str | None = None) -> pa.ListArray:
    """One list a text; ``shift`` adds to each fragment's values the number of groups before it."""
    every = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64)
    values = memo.gather(name, size, every)
    sizes = memo.flat()[1]
    if shift:
        before = np.concatenate([np.cumsum(sizes[shift][n]) - sizes[shift][n] for n in numbers]) if len(every) else every
        values = values + np.repeat(before, sizes[size][every])
    ends = np.cumsum([0, *(int(sizes[size][n].sum()) for n in numbers)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(np.int32)))


def _sums(memo: _Fragments, numbers: list[np.ndarray], size: str) -> list[int]:
    return [int(memo.flat()[1][size][n].sum()) for n in numbers]


def _pairs(memo: _Fragments, numbers: list[np.ndarray]) -> tuple[pa.ListArray, pa.ListArray]:
    """Each text's distinct linked id pairs, B's id in the upper half of a long, and how often each occurs."""
    sizes = memo.flat()[1]["links"]
    every = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64)
    key = memo.gather("lb", "links", every).astype(np.int64) << 32 | memo.gather("la", "links", every)
    of = np.repeat(np.repeat(np.arange(len(numbers)), [len(n) for n in numbers]), sizes[every])
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    fresh = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    offsets = pa.array(np.searchsorted(of[fresh], np.arange(len(numbers) + 1)), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(key[fresh])), pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.append(fresh, len(key))), pa.int64()))


def _mapped(df: DataFrame, text_col: str, keep: tuple[str, ...], make: Callable, fields: dict[str, tuple[str, pa.DataType]], rows: Callable) -> DataFrame:
    own = df.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in own.dtypes[:-1]), *(f"`{n}` {t}" for n, (t, _) in fields.items())])
    return own.mapInArrow(_run(make, own.columns[:-1], {n: t for n, (_, t) in fields.items()}, rows), schema)


def token_groups(df: DataFrame, make: Callable, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``a_ids, b_ids, a_groups, b_groups`` (arrays of int): each text's tokens and the group of each.

    ``make`` gives the two tokenizers inside a task (``ByteBpe``, ``PieceBpe``
    or others with ``encode``, ``bytes`` and ``lengths``).  A text that is null or empty, or
    whose bytes either side does not give back, has no tokens.  Rows are
    independent; an empty table gives an empty one.
    """
    ints = ("array<int>", pa.list_(pa.int32()))

    def rows(memo, numbers):
        return _lists(memo, numbers, "a", "a"), _lists(memo, numbers, "b", "b"), _lists(memo, numbers, "ga", "a", "groups"), _lists(memo, numbers, "gb", "b", "groups")

    return _mapped(df, text_col, keep, make, dict.fromkeys(("a_ids", "b_ids", "a_groups", "b_groups"), ints), rows)


def _digest(memo: _Fragments, numbers: np.ndarray) -> str:
    if not len(numbers):
        return ""
    return hashlib.sha256(";".join([memo.texts[i] for i in numbers.tolist()]).encode()).hexdigest()


def linked(df: DataFrame, make: Callable, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``n_a, n_b, n_groups, n_links, groups_sha256`` and each text's id pairs (``pairs``, ``times``).

    A pair is B's id times 2**32 plus A's.  ``groups_sha256`` is the digest of
    the groups in decimal ids, empty where a text has no tokens.
    """
    long = ("long", pa.int64())
    fields = {"n_a": long, "n_b": long, "n_groups": long, "n_links": long, "groups_sha256": ("string", pa.string()), "pairs": ("array<long>", pa.list_(pa.int64())), "times": ("array<long>", pa.list_(pa.int64()))}

    def rows(memo, numbers):
        return *(_sums(memo, numbers, k) for k in ("a", "b", "groups", "links")), [_digest(memo, n) for n in numbers], *_pairs(memo, numbers)

    return _mapped(df, text_col, keep, make, fields, rows)


def pair_counts(links: DataFrame) -> DataFrame:
    """``pair, n, best``: how many links of the corpus hold an id pair, and whether no other pair of its B id has more.

    Each task adds up its own pairs; the salt, by task, then shares the rows of
    a pair that is everywhere, and the second sum has ``SALTS`` rows a pair at most.
    """
    each = links.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    parts = each.groupBy(F.col("x.pairs").alias("pair"), "salt").agg(F.sum("x.times").alias("n"))
    counted = stored(parts.groupBy("pair").agg(F.sum("n").alias("n")))
    most = counted.groupBy(_b_id().alias("b")).agg(F.max("n").alias("most"))
    return counted.withColumn("b", _b_id()).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _b_id() -> Column:
    return F.shiftrightunsigned("pair", 32)


def alignment(df: DataFrame, make: Callable, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``keep`` columns plus ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``count_sum`` adds up, over a text's links, how many links of the corpus
    have the same two ids; ``n_best`` counts the links whose pair has the most
    of its B id, ties included.  Up to ``most_broadcast`` pairs are broadcast,
    more are joined by a shuffle.  A null or empty text, or one whose bytes
    either side does not give back, has zeros and an empty digest; repeated rows
    count again and each has its row; an empty table gives an empty one.
    """
    at = spare(df.select(*keep), "row_number")
    rows = stored(linked(df, make, text_col, keep).withColumn(at, F.monotonically_increasing_id()))
    counts = stored(pair_counts(rows))
    counts = F.broadcast(counts) if counts.count() <= most_broadcast else counts.hint("merge")
    each = rows.select(at, F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(at, F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    totals = each.join(counts, "pair").groupBy(at).agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    own = rows.drop("pairs", "times").join(totals, at, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return own.select(*keep, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
