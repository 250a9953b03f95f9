"""Byte-pair encoding and decoding by forced-boundary splitting.

A merge can only join two neighbouring bytes if some vocabulary token holds
those bytes side by side.  A byte pair that occurs inside no token is thus a
certain cut: what stands left and right of it can be encoded independently and
the results concatenated.  White space occurs inside no token of a vocabulary
whose pre-tokenizer drops it, so every white space is such a cut; inside a word
the pair table decides.  Fragments repeat heavily in a corpus, so each Python
worker keeps a bounded memo of fragment results; texts never meet, no shuffle
is needed and a lost executor only repeats its own tasks.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lone, per_text

#: Bytes, by estimate, of one generation of a worker's memo; two generations are kept.
MEMO_BYTES = 12 << 20

_FRAGMENT = re.compile("[^ \t\n\r\f\v]+")
#: Letters for which lower-casing and the word pattern below agree with the
#: library in every Unicode version; anything else takes the library's own path.
_LETTERS = "a-zß-öø-ÿĀ-įĲ-ſ"
_PLAIN = re.compile("[\\x00-\\x1b\\x20-\\x7eÀ-ÖØ-öø-įĲ-ſ\u2010-\u2027]*")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ \t\n\r\f\v{_LETTERS}0-9]+")


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class _Memo(dict):
    """word -> (ids, tokens); the older of two generations is dropped when full."""

    def __init__(self, compute):
        self.compute, self.older, self.held = compute, {}, 0

    def __missing__(self, word):
        got = self.older.get(word) or self.compute(word)
        if self.held >= MEMO_BYTES:
            self.older, self.held = dict(self), 0
            self.clear()
        if len(word) <= 128:
            self[word] = got
            # Three strings, a pair and a place in the table besides the letters.
            self.held += 300 + len(word) + len(got[0]) + len(got[1])
        return got


class ForcedBoundaryEncoder:
    """Encodes and decodes with one tokenizers-library file with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        suffix = spec["model"]["end_of_word_suffix"]
        inner = spec | {"model": spec["model"] | {"end_of_word_suffix": None}}
        self.last_model, self.inner_model = self.tokenizer.model, Tokenizer.from_str(json.dumps(inner)).model
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: The vocabulary's text of each id, by which ids are decoded.
        self.texts = {i: token for token, i in (spec["model"]["vocab"] | self.special).items()}
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.letters = _byte_letters()
        self.pairs = set()
        for token in spec["model"]["vocab"]:
            body = token.removesuffix(suffix)
            self.pairs.update(zip(body, body[1:]))
        self.words = _Memo(lambda w: self.word(w if w.isascii() and w.isprintable() else "".join([self.letters[b] for b in w.encode()])))
        self.fragments = _Memo(self.fragment)

    def cuts(self, word: str) -> list[str]:
        """``word`` (byte-level letters) split at every pair inside no token."""
        out, at, pairs = [], 0, self.pairs
        if pairs.issuperset(zip(word, word[1:])):
            return [word]
        for i, pair in enumerate(zip(word, word[1:]), 1):
            if pair not in pairs:
                out.append(word[at:i])
                at = i
        out.append(word[at:])
        return out

    def word(self, word: str) -> tuple[str, str]:
        """Ids and tokens, space-joined, of one word in byte-level letters."""
        *inner, last = self.cuts(word)
        got = [t.id for piece in inner for t in self.inner_model.tokenize(piece)] + [t.id for t in self.last_model.tokenize(last)]
        return " ".join(map(str, got)), self.decode(got)

    def fragment(self, raw: str) -> tuple[str, str]:
        """As ``word``, of any text: special tokens, normalizer and word split are the library's."""
        got = []
        for part in self.special_re.split(raw):
            if part in self.special:
                got.append((str(self.special[part]), self.decode([self.special[part]])))
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part)
                got += [self.word(w) for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return " ".join([x for x, _ in got]), " ".join([x for _, x in got])

    def encode(self, text: str) -> tuple[str, str]:
        """Ids and decoded text, each space-joined, of a whole text."""
        if "<|" not in text and _PLAIN.fullmatch(text):
            got = [self.words[w] for w in _WORDS.findall(text.lower())]
        else:
            got = []
            for raw in _FRAGMENT.findall(text):
                if "<|" not in raw and _PLAIN.fullmatch(raw):
                    got += [self.words[w] for w in _WORDS.findall(raw.lower())]
                elif (pair := self.fragments[raw])[0]:
                    got.append(pair)
        return " ".join([x for x, _ in got]), " ".join([x for _, x in got])

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's texts of ``ids``, space-joined, as a tokenizer without a decoder of its own gives them; unknown ids are left out."""
        return " ".join([self.texts[i] for i in ids if i in self.texts])


def encoder(path: str) -> ForcedBoundaryEncoder:
    return lone(("encoder", path), lambda: ForcedBoundaryEncoder(path))


def _count(row: tuple[str, str]) -> int:
    return row[0].count(" ") + 1 if row[0] else 0


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def encode_texts(df: DataFrame, tokenizer_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``n_tokens``, ``ids array<int>`` and ``decoded``.

    Null text counts as empty: no ids, decoded "".  Rows are independent:
    repeated rows give repeated results, an empty table an empty one.  Texts of
    any length are encoded whole.  ``decoded`` equals the library's
    ``decode(ids, skip_special_tokens=False)``.
    """

    def row(text):
        got = encoder(tokenizer_path).encode(text or "")
        return _count(got), np.array(got[0].split(), dtype=np.int32), got[1]

    fields = [("n_tokens", "long", pa.int64()), ("ids", "array<int>", pa.list_(pa.int32())), ("decoded", "string", pa.string())]
    return per_text(df, text_col, keep, fields, row)


def decode_ids(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``decoded``, the vocabulary's text for the ids (null ids: empty; an empty table: an empty one)."""
    return per_text(df, ids_col, keep, [("decoded", "string", pa.string())], lambda ids: (encoder(tokenizer_path).decode(ids or []),))


def encode_digests(df: DataFrame, tokenizer_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As ``encode_texts``, with sha256 digests in place of ids and decoded text.

    ``ids_sha256`` is over the decimal ids joined by one space,
    ``decoded_sha256`` over the decoded text in UTF-8.
    """

    def row(text):
        got = encoder(tokenizer_path).encode(text or "")
        return _count(got), _sha(got[0]), _sha(got[1])

    fields = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return per_text(df, text_col, keep, fields, row)


def token_lengths(df: DataFrame, tokenizer_path: str, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns plus ``n_tokens`` of every whole text (null: 0)."""
    return per_text(df, text_col, keep, [("n_tokens", "long", pa.int64())], lambda text: (_count(encoder(tokenizer_path).encode(text or "")),))
