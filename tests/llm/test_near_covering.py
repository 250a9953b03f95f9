"""The near stage takes anchor-point covering in full: near fingerprints meet whatever their nearest anchors are."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from folioframe.llm import resemblance, simhash


def _anchor(fp):
    return next(simhash._placed(None)(iter([pa.RecordBatch.from_arrays([pa.array([fp], pa.int64())], names=["fp"])]))).column(1)[0].as_py()


def test_pairs_over_an_anchors_border(spark, monkeypatch):
    rng = random.Random(3)
    while True:
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        texts = [" ".join(words), " ".join([*words[:-1], f"v{rng.randrange(10**6)}"])]
        a, b = (simhash.fingerprint(x, resemblance.WORDS_PER_SHINGLE) for x in texts)
        if 0 < bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 and _anchor(a) != _anchor(b):
            break
    monkeypatch.setattr(resemblance, "_bands", lambda bins: F.array().cast("array<bigint>"))
    got = resemblance.links(spark.createDataFrame(list(enumerate(texts)), "key long, text string"))
    assert [tuple(r) for r in got.collect()] == [(0, 1)]
