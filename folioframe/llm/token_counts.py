"""Token counts from an exact length histogram.

Documents are counted by encoded length, pre-aggregated per task; all that
follows reads the histogram, one row per length that occurs.  Suffix sums over
it answer, for every context limit, how many documents reach the limit and how
many tokens remain if texts are truncated there; prefix sums answer quantiles.
The sums go by blocks of lengths, so no task sums the whole histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import token_lengths
from .common import cut

#: Lengths that one task sums up together.
BLOCK = 128


def length_histogram(df: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``n_tokens, docs``: documents by encoded length.

    Null and empty texts count as length 0, repeated rows as often as they
    occur; an empty table gives an empty histogram.
    """
    return token_lengths(df, tokenizer_path, text_col).groupBy("n_tokens").agg(F.count("*").alias("docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with sums from each length on.

    ``n_tokens, docs, tokens, docs_from, tokens_from, docs_to, truncated_tokens``:
    documents and tokens of this length, of at least this length, documents of
    at most this length, and the corpus's tokens if every text is cut at it.
    The histogram is materialised once: it is read twice, and behind it lies
    the encoding of the whole corpus.
    """
    rows = cut(histogram).select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    zero = F.lit(0).cast("long")
    everything = Window.partitionBy()
    later = blocks.select("block", F.coalesce(F.sum("d").over(above), zero).alias("d"), F.coalesce(F.sum("t").over(above), zero).alias("t"), F.sum("d").over(everything).alias("all_docs"), F.sum("t").over(everything).alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    summed = rows.withColumn("docs_from", F.sum("docs").over(inside)).withColumn("tokens_from", F.sum("tokens").over(inside)).join(later, "block")
    docs_from, tokens_from = F.col("docs_from") + F.col("d"), F.col("tokens_from") + F.col("t")
    return summed.select(
        "n_tokens",
        "docs",
        "tokens",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        (F.col("all_docs") - docs_from + F.col("docs")).alias("docs_to"),
        (F.col("all_tokens") - tokens_from + F.col("n_tokens") * docs_from).alias("truncated_tokens"),
    )


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens left if every text is cut at ``limit``; 0 for an empty corpus."""
    nxt = sums.where(F.col("n_tokens") >= limit).orderBy("n_tokens").first()
    if nxt is not None:
        below = nxt.truncated_tokens - nxt.n_tokens * nxt.docs_from
        return below + limit * nxt.docs_from
    top = sums.orderBy(F.desc("n_tokens")).first()
    return top.truncated_tokens if top else 0


def quantile(sums: DataFrame, q: float) -> int | None:
    """The least length that a share ``q`` of the documents does not exceed; null for an empty corpus."""
    total = sums.agg(F.max("docs_to")).first()[0]
    return total and sums.where(F.col("docs_to") >= q * total).agg(F.min("n_tokens")).first()[0]
