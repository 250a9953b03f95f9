"""Collocations against a count of every phrase in plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import phrases

SCHEMA = "doc_id long, text string, lang string, word string, block long, rank string"
TEXTS = [
    ("the red fox. the red fox, the red fox! a red fox", "en"), ("The RED fox\nthe\tred  fox;the red fox jumps over", "en"), ("x y x y x y x y x y", "en"), ("ÄB äb ÄB äb. Straße ist. straße ist", "de"),
    ("straße ist: straße ist. STRAßE ist", "de"), ("the red fox", "de"), ("the red fox the red fox", None), ("the red fox", "und"), (None, "en"), ("", "fr"), (" \t.,;:!?\n\x0b\x0c\r", None), ("one", "es"),
    ("a\x01b c\xa0d a\x01b c\xa0d a\x01b c\xa0d", "en"), ("日本 語 日本 語 日本 語", None), ("long " * 700, "en"), ("a b c d e a b c d e a b c d e", "fr"),
]


def brute(rows, least, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, size = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(low)):
            words = re.findall("[^ \t]+", piece)
            size[lang] += len(words)
            for n in range(1, 5):
                count[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, c in count.items():
        often = {p: f for p, f in c.items() if f >= least}
        kept = []
        for p, a in often.items():
            inside = any(100 * f >= 80 * a for q, f in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if len(p) > 1 and not inside:
                score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, size[lang], -score))
    return sorted(out)


def got(df, least, top):
    return sorted(map(tuple, phrases.collocations(df, least=least, top=top).collect()))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, g, "clash", None, "clash") for i, (t, g) in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[:3] + [(None, None, None, None, None, None)], SCHEMA).cache()


@pytest.mark.parametrize(("least", "top"), [(2, 2000), (3, 4), (5, None), (1, 1000)])
def test_equals_brute_force(odd, least, top):
    want = brute([(r.text, r.lang) for r in odd.collect()], least, top)
    assert want and got(odd, least, top) == want


@pytest.mark.parametrize("most_ranges", [9, 1000])
def test_many_blocks_ranges_and_buckets(spark, monkeypatch, most_ranges):
    """Blocks of a few words, sorts of a few n-grams, ranges split by a hash: the same counts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.text, r.lang) for r in docs.collect()], 12, 300)
    for name, value in {"BLOCK_WORDS": 900, "HELD_GRAMS": 4000, "RANGE_GRAMS": 2000, "MOST_RANGES": most_ranges, "SAMPLE_STEP": 7}.items():
        monkeypatch.setattr(phrases, name, value)
    assert got(docs, 12, 300) == want


def test_empty_table(spark):
    assert got(spark.createDataFrame([], SCHEMA), 2, 10) == []


def test_scores_are_exact(spark):
    rows = [(a, a + b, a + c) for a, b, c in [(30, 0, 0), (1, 1, 3), (10**13, 7, 9), (4 * 10**18, 1, 5 * 10**17), (7, 5, 10**18)]]
    frame = spark.createDataFrame(rows, "a long, l long, r long")
    assert [r.s for r in frame.select(phrases.dice(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()] == [2000000 * a // (x + y) for a, x, y in rows]


def test_radix_order_and_runs():
    rng = np.random.default_rng(5)
    upper, lower = (rng.integers(0, 1 << 63, 5000, dtype=np.uint64) >> rng.integers(0, 60, 5000).astype(np.uint64) for _ in range(2))
    upper, lower = np.repeat(upper, 2), np.tile(lower, 2)
    order = phrases.radix_order(upper, lower)
    keys = list(zip(upper.tolist(), lower.tolist()))
    assert [keys[i] for i in order] == sorted(keys)
    u, w, n = phrases.run_lengths(upper, lower, np.full(len(upper), 3))
    assert dict(zip(zip(u.tolist(), w.tolist()), n.tolist())) == {k: 3 * c for k, c in Counter(keys).items()}
