"""Alignment of two tokenizers against the whole texts' tokens, offset by offset."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from folioframe.llm import alignment, queries

SCHEMA = "doc_id long, text string, pairs string, row_number string"
TEXTS = [
    None, "", " ", "  ", "a", " a", "  a  b ", "a b", "don't we'll I'M", "a\tb\nc \n d\n\n  e", "x▁y", "▁", "a▁ b", "a ▁b", "<s> </s> <unk> <pad>", "<|endoftext|> <|endoftext|>", "<0x41> <0x0A>", "naïve Straße ÀÉ ﬁ", "é combining é",
    "日本語 テキスト", "🎉 party 🎉", " x 　 y", "a\x00b \x01", "word " * 3000, "x" * 3000, " " * 40 + "y", "a" + " " * 17 + "b", "1234 567,890.12 !!! ?? ...", "  a  b\x85 c", "﻿bom", "İstanbul ıI", "a\r\n b\x0b\x0c c",
]


def whole(texts):
    """The contract's columns, from tokens of whole texts and loops over their ends."""
    one, other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    one.encode_special_tokens = True
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = [b for b in range(256) if b not in printable]
    letter = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(free)}
    rows, links = [], Counter()
    for text in texts:
        a = b = []
        if text:
            a, b = one.encode(" " + text, add_special_tokens=False).ids, other.encode(text)
            a_bytes = [bytes(letter[c] for c in one.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(other.id_to_piece(i)[3:-1], 16)]) if other.is_byte(i) else other.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                a = b = []
        a_end, b_end = ([*np.cumsum([len(x) for x in y])] if z else [] for y, z in ((a and a_bytes, a), (b and b_bytes, b)))
        groups, own, i, j = [], [], 0, 0
        for cut in sorted({*a_end} & {*b_end}):
            x, y = a_end.index(cut, i) + 1, b_end.index(cut, j) + 1
            groups.append((a[i:x], b[j:y]))
            own.append((a[x - 1], b[y - 1]))
            i, j = x, y
        rows.append((len(a), len(b), groups, own))
        links.update(own)
    most = Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    out = []
    for n_a, n_b, groups, own in rows:
        sha = hashlib.sha256(";".join("|".join(",".join(map(str, side)) for side in g) for g in groups).encode()).hexdigest() if groups else ""
        out.append((n_a, n_b, len(groups), len(own), sum(links[x] == most[x[1]] for x in own), sum(links[x] for x in own), sha))
    return out


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    bits = ["a", " ", "  ", "the", " The", "\n", "\t", "é", "ß", "▁", "'s", "12", ".", "日", " ", "<s>", "🎉", "́", "-", "İ"]
    texts = TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    return spark.createDataFrame([(i, t, "clash", None) for i, t in enumerate(texts)] + [(3, "  ", None, None), (None, "a b", None, None), (None, None, None, None), (5, " a", "clash", None)], SCHEMA).cache()


@pytest.mark.parametrize("most", [10**6, 0])
def test_equals_whole_texts(odd, most):
    """With the counts broadcast and joined by a shuffle."""
    rows = odd.collect()
    want = Counter((r.doc_id, *w) for r, w in zip(rows, whole([r.text for r in rows])))
    assert Counter(map(tuple, alignment.alignment(odd, queries.token_pair, most_broadcast=most).collect())) == want


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    want = {(r.doc_id, *w) for r, w in zip(rows, whole([r.text for r in rows]))}
    got = queries.op12_alignment(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert set(map(tuple, got.collect())) == want


def test_small_memo(odd, monkeypatch):
    """A memo that begins anew all the time, texts one by one."""
    monkeypatch.setattr(alignment, "MEMO_BYTES", 1)
    made = alignment.Aligner(*queries.token_pair())
    for text in [x for x in TEXTS if x]:
        numbers = made.batch([text])
        assert alignment._digest(made.memo, numbers[0]) == whole([text])[0][-1]


def test_token_groups(odd):
    """Ids, and groups that grow from 0 without a gap on both sides."""
    for r in alignment.token_groups(odd, queries.token_pair, keep=("doc_id", "text", "pairs")).collect():
        for ids, groups in ((r.a_ids, r.a_groups), (r.b_ids, r.b_groups)):
            assert len(ids) == len(groups) and sorted(set(groups)) == list(range(len(set(groups)))) and groups == sorted(groups)
        assert set(r.a_groups) == set(r.b_groups)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert alignment.alignment(empty, queries.token_pair).collect() == [] and alignment.token_groups(empty, queries.token_pair).collect() == []
