"""Each pipeline stage against brute force on what its predecessor kept."""

import hashlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp

from .test_operators import SF, TOKENIZER
from .test_resemblance import _want


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    extra = spark.createDataFrame([(9001, None, None, None, None), (9002, "12 !!", "en", "src0", 5), (None, "A text without an id of its own.", "en", None, 3)], docs.schema)
    docs = docs.unionByName(extra).cache()
    kept = dict(cp.STAGES)["language"](spark, docs, SF).cache()
    assert kept.columns == columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {9001, 9002}
    once = dict(cp.STAGES)["exact"](spark, kept, SF).cache()
    last = {}
    for r in kept.collect():
        last[r.text] = max(last.get(r.text, -1), -1 if r.doc_id is None else r.doc_id)
    assert once.columns == columns and Counter((r.text, -1 if r.doc_id is None else r.doc_id) for r in once.collect()) == Counter(last.items())
    apart = dict(cp.STAGES)["near"](spark, once, SF).cache()
    # The stage's rule is five words and a similarity of 0.8, not op4's three words and two bits.
    groups = _want(once.collect())
    stays = Counter(min((r.doc_id is None, r.doc_id or 0) for r in g) for g in groups.values())
    assert len(groups) < once.count()
    assert apart.columns == columns and Counter((r.doc_id is None, r.doc_id or 0) for r in apart.collect()) == stays
    mixed = dict(cp.STAGES)["mixed"](spark, apart, SF).cache()
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and max(times.values()) <= 3 and set(times) <= {r.doc_id for r in apart.collect()}
    ids = dict(cp.STAGES)["encoded"](spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in ids) == times and all(len(r.ids) == r.n_tokens for r in ids)
    lib = Tokenizer.from_file(TOKENIZER)
    assert all(r.decoded_sha256 == hashlib.sha256(lib.decode(r.ids, skip_special_tokens=False).encode()).hexdigest() for r in ids)


def test_run_is_the_stages(spark):
    got = cp.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF).cache()
    assert got.columns == ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"] and got.count() > 0
    rows = lambda df: Counter((r.doc_id, r.source, r.n_tokens, tuple(r.ids)) for r in df.collect())
    assert rows(got) == rows(docs)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, keep_id string, sha string, taken int"


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_bear_empty_tables_and_clashing_names(spark, name):
    stage = dict(cp.STAGES)[name]
    assert stage(spark, spark.createDataFrame([], SCHEMA), SF).isEmpty()
    text = "the same words as in the other row of this id"
    rows = [(1, text, "en", "s", 3, "k", None, "x", 7), (1, text, "en", "s", 3, "k", None, "x", 7), (1, text + " but more", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = stage(spark, df, SF)
    assert got.count() <= 12 and (name == "encoded" or got.columns == df.columns)
    if name in ("exact", "near"):
        assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((i, t) for i, t in {x[:2] for x in rows})
