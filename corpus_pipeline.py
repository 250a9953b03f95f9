"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; all but the last return the columns of documents.
All bear extra columns, empty tables (the result is empty, too), nulls in any
column, equal ids and equal rows; what becomes of those is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import bpe, exact_dedup, langid, mixing, resemblance
from folioframe.llm.common import forget, stored, table

#: Texts further than this from every language are not in any of them.
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the corpus.

    Texts that are null or have no letter go, and those too far from every
    language.  Repeated rows stay repeated; ids play no part.
    """
    told = langid.identify(docs, langid.profiles(docs), keep=tuple(docs.columns))
    return told.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id.

    Null text counts as empty, a null id stays only where its group has no
    other, equal rows come back once.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the one with the least id.

    Texts without words are near copies of each other; a null id comes after
    all others; of one id the least text digest stays, of equal rows any one.
    """
    return resemblance.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document comes as often as the mix takes it.

    A null source is one of its own, texts without words (null ones, too) have
    no size and are not taken, repeated rows are taken one by one.
    """
    return mixing.apply_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids, decoded_sha256`` of every text, row by row; of a null or empty one no ids.

    The digest is of what the ids decode to.
    """
    got = bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "source"))
    return got.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixed", mixed), ("encoded", encoded)]

#: No stage but exact deduplication can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one keeps is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    kept = []
    for _, stage in STAGES[:-1]:
        kept.append(stored(stage(spark, kept[-1] if kept else docs, sf_dir)))
        if len(kept) > 1:
            forget(spark, kept[-2])
    return STAGES[-1][1](spark, kept[-1], sf_dir)
