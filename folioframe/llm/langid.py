"""Language identification by rank-order n-gram profiles.

A language's profile is its most frequent letter n-grams (one to three
letters, word edges marked) in rank order.  A document's own most frequent
n-grams are ranked alike; its distance to a language is the sum over them of
how far out of place each stands in the profile, ``profile_size`` where it is
missing.  The nearest language wins.

Profiles are counted over all training rows: numpy counts inside tasks, a
grouped sum pre-aggregated per task across them.  The profiles (languages x
``profile_size`` rows) are what the tasks then hold; documents never meet.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lone, per_text

#: N-grams kept of a language and of a document.
PROFILE_SIZE = 400
#: Code points counted in one numpy pass; longer texts take several.
CHUNK = 1 << 19
#: Distinct n-grams a counting task holds before it hands them on.
HELD = 1 << 20

UNDETERMINED = "und"


def _letter_table() -> np.ndarray:
    """Code point -> itself for letters, 0 for anything else."""
    return np.arange(0x110000, dtype=np.int32) * np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _letters() -> np.ndarray:
    return lone("letters", _letter_table)


def _codes(text: str) -> np.ndarray:
    """Lower-case letters as code points, every run of others as one 0, edges marked."""
    low = unicodedata.normalize("NFC", text).lower()
    raw = np.frombuffer(low.encode("utf-32-le", "replace"), dtype="<u4")
    codes = _letters()[raw].astype(np.int64)
    codes = np.concatenate([[0], codes, [0]])
    keep = codes != 0
    keep[0] = True
    keep[1:] |= codes[:-1] != 0
    return codes[keep]


def _grams(codes: np.ndarray, starts: int | None = None) -> np.ndarray:
    """The n-grams that begin at the first ``starts`` places (by default all), as integers: 21 bits a letter, 0 for a word's edge."""
    one = codes[:starts]
    a, b = codes[:-1][:starts], codes[1:][:starts]
    two = ((a << 21) | b)[(a != 0) | (b != 0)]
    a, b, c = codes[:-2][:starts], codes[1:-1][:starts], codes[2:][:starts]
    three = ((a << 42) | (b << 21) | c)[b != 0]
    # the two highest bits tell the lengths apart
    return np.concatenate([one[one != 0], two | np.int64(1 << 62), three | np.int64(-(1 << 63))])


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's distinct n-grams, ascending, and how often each occurs."""
    codes = _codes(text)
    if len(codes) <= CHUNK:
        return np.unique(_grams(codes), return_counts=True)
    return _merged([np.unique(_grams(codes[i : i + CHUNK + 2], CHUNK), return_counts=True) for i in range(0, len(codes), CHUNK)])


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(at, weights=np.concatenate([c for _, c in parts]), minlength=len(grams)).astype(np.int64)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(*batch.columns):
            got = _counts(text.as_py())
            held.setdefault(lang.as_py(), []).append(got)
            size += len(got[0])
            if size >= HELD:
                held = {k: [_merged(v)] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size >= HELD // 2:
                    yield from _rows(held)
                    held, size = {}, 0
    yield from _rows(held)


def _rows(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
    for lang, parts in held.items():
        grams, counts = _merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])


def profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE_SIZE) -> DataFrame:
    """``lang, rank, gram`` of every language with a letter in its texts.

    Rows without text or language teach nothing; an empty table gives no
    profiles.  Ties in frequency rank by the n-gram's code.
    """
    own = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = own.mapInArrow(_count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # A language's top grams are first cut within hash slices, so no task ranks a whole language.
    order = [F.desc("n"), F.asc("gram")]
    slices = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(*order)
    top = counts.withColumn("r", F.row_number().over(slices)).where(F.col("r") <= size)
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1)
    return ranked.where(F.col("rank") < size).select("lang", "rank", "gram")


class RankModel:
    """Profiles as arrays: ``predict`` gives (language, score) of a text."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size = size
        self.langs = sorted({lang for lang, _, _ in rows})
        self.vocab = np.array(sorted({gram for _, _, gram in rows}), dtype=np.int64)
        self.ranks = np.full((len(self.vocab) + 1, len(self.langs)), -1, dtype=np.int32)
        for lang, rank, gram in rows:
            self.ranks[np.searchsorted(self.vocab, gram), self.langs.index(lang)] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, counts = _counts(text) if text else ((), ())
        if not len(grams) or not self.langs:
            return UNDETERMINED, 0.0
        order = np.argsort(-counts, kind="stable")[: self.size]
        top = grams[order]
        at = np.searchsorted(self.vocab, top)
        at[(at == len(self.vocab)) | (self.vocab[np.minimum(at, len(self.vocab) - 1)] != top)] = len(self.vocab)
        ranks = self.ranks[at]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top))[:, None]))
        total = away.sum(axis=0)
        best = int(total.argmin())
        return self.langs[best], float(1 - total[best] / (self.size * len(top)))


def identify(df: DataFrame, model_rows: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = PROFILE_SIZE) -> DataFrame:
    """``keep`` columns plus ``lang_pred`` and ``score`` of every whole text.

    ``und`` and 0 where the text is null or has no letter, or nothing was
    learned.  Ties between languages go to the first by name.  ``score`` is one
    less the nearest language's share of the largest possible distance.
    """
    rows = [tuple(r) for r in model_rows.select("lang", "rank", "gram").collect()]  # languages x size
    shared = df.sparkSession.sparkContext.broadcast(RankModel(rows, size))

    fields = [("lang_pred", "string", pa.string()), ("score", "double", pa.float64())]
    return per_text(df, text_col, keep, fields, lambda text: shared.value.predict(text))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text mod 5 is 0 (null id: as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
