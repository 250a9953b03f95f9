"""Measures and digests of texts."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of a token in an estimate, and tokens of one request.
LETTERS_PER_TOKEN, TARGET_LETTERS_PER_TOKEN, REQUEST_TOKENS = 4, 3, 150_000


def estimated_tokens(text: Column, letters: int = LETTERS_PER_TOKEN) -> Column:
    """Whole tokens of ``letters`` code points that a text fills; null counts as empty."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / letters).cast("long")


def _canonical(value: str | None) -> str | None:
    try:
        told = json.dumps(json.loads(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
        return hashlib.sha256(told.encode("utf-8")).hexdigest()
    except (TypeError, ValueError):
        return None


def canonical_json_sha256(value: Column) -> Column:
    """Digest of a JSON text with sorted keys and no spaces; null for null, text that is no JSON, and NaN."""

    def each(values: pd.Series) -> pd.Series:
        return values.map(_canonical)

    return F.pandas_udf(each, "string")(value)
