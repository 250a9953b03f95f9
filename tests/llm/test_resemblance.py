"""Near copies of the pipeline's stage against brute force over all pairs of shingle sets."""

from collections import Counter
from itertools import combinations

import corpus_pipeline as cp
from folioframe.llm import resemblance

from .test_operators import SF, _least


def _set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def _groups(rows):
    sets = [_set(r.text) for r in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if _jaccard(sets[i], sets[j]) >= 0.8]
    return _least(links, range(len(rows)))


def _want(rows):
    root, groups = _groups(rows), {}
    for i, r in enumerate(rows):
        groups.setdefault(root[i], []).append(r)
    return groups


def _planted(spark):
    """Documents, and copies with one to six words changed, some without an id or with a taken one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = [r for r in docs.where("doc_id is not null").orderBy("doc_id").collect() if 120 <= len((r.text or "").split()) <= 400][:40]
    made = []
    for n, r in enumerate(long):
        words = r.text.split()
        for i in range(1 + n % 6):
            words[(i * 19 + 7) % len(words)] = f"planted{n}x{i}"
        made.append((None if n % 10 == 3 else r.doc_id if n % 10 == 5 else 50_000 + n, " ".join(words), r.lang, r.source, None))
    return docs.unionByName(spark.createDataFrame(made, docs.schema)), len(made)


def test_near_stage_drops_planted_copies(spark):
    docs, planted = _planted(spark)
    docs = docs.dropDuplicates(["text"]).cache()
    groups = _want(docs.collect())
    got = dict(cp.STAGES)["near"](spark, docs, SF)
    assert got.columns == docs.columns and sum(len(g) > 1 for g in groups.values()) > planted / 2
    first = {min((r.doc_id is None, r.doc_id or 0) for r in g) for g in groups.values()}
    rows = got.collect()
    assert len(rows) == len(groups) and {(r.doc_id is None, r.doc_id or 0) for r in rows} == first
    kept = Counter(r.text for r in rows)
    assert all(sum(kept[r.text] for r in g) == 1 for g in groups.values())


def test_large_bands_hang_together(spark, monkeypatch):
    """Three families of near copies, more than ``FEW``, and texts that only share a passage with them."""
    monkeypatch.setattr(resemblance, "FEW", 4)
    shared = [f"s{i}" for i in range(300)]
    texts = [" ".join([*shared, *(f"{family}{i}" for i in range(40)), f"last{n}"]) for family in "abc" for n in range(12)]
    texts += [" ".join([*shared[:150], *(f"own{n}x{i}" for i in range(100))]) for n in range(4)] + ["", " ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    want = {min(r.doc_id for r in g) for g in _want(df.collect()).values()}
    assert {r.doc_id for r in resemblance.drop_near_copies(df).collect()} == want


def test_four_fifths_is_the_edge():
    ten = set(range(10))
    assert resemblance.alike(ten, set(range(8))) and not resemblance.alike(ten, set(range(7)))
    assert resemblance.alike(set(), set()) and not resemblance.alike(set(), ten) and not resemblance.alike(set(range(9)), set(range(1, 10)) - {5})
