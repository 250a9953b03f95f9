"""Tables and the outline view that the queries read."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: One outline document per customer, one paragraph per order line; the same
#: statement runs on other SQL engines.
OUTLINE = """
WITH b AS (
  SELECT o.o_custkey AS doc_id, l.l_returnflag AS rf,
         row_number() OVER (PARTITION BY o.o_custkey
           ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_returnflag, l.l_linestatus) - 1 AS idx
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
c AS (SELECT doc_id, idx, rf, (idx - 2) % 18 AS r,
             CAST(CAST(floor((idx - 2) / 18.0) AS BIGINT) + 1 AS VARCHAR(20)) AS p FROM b)
SELECT doc_id, CAST(idx AS BIGINT) AS paragraph_index,
  CASE WHEN idx = 0 THEN concat('SECTION ', lpad(CAST(1 + doc_id % 49 AS VARCHAR(20)), 2, '0'), ' 10 00')
       WHEN idx = 1 THEN 'SUMMARY OF WORK'
       WHEN r = 0  THEN concat('PART ', p, ' - GENERAL')
       WHEN r = 1  THEN concat(p, '.01 SUMMARY')
       WHEN r = 2  THEN 'A. Scope'
       WHEN r = 3  THEN '1. Item'
       WHEN r = 4  THEN CASE WHEN rf = 'R' THEN 'c. Detail' ELSE 'a. Detail' END
       WHEN r = 5  THEN '1) Deep five'
       WHEN r = 6  THEN 'a) Deep six'
       WHEN r = 7  THEN '(1) Deep seven'
       WHEN r = 8  THEN '(a) Deep eight'
       WHEN r = 9  THEN 'B. Second'
       WHEN r = 10 THEN '1. Item'
       WHEN r = 11 THEN '2. Item'
       WHEN r = 12 THEN '[Editor note: choose one]'
       WHEN r = 13 THEN 'Plain prose line'
       WHEN r = 14 THEN concat(p, '.02 REFERENCES')
       WHEN r = 15 THEN 'A. Codes'
       WHEN r = 16 THEN CASE WHEN rf = 'N' THEN 'C. Gap' ELSE 'B. Standards' END
       ELSE '' END AS text
FROM c"""

#: Rows of a task where a step deals them by their number, so that a task's memory doesn't grow with the tables.
ROWS = 1 << 18

_JOINED = "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"
_DEALT = """FROM (SELECT /*+ REPARTITION({parts}, o_custkey) */ o_custkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey) l"""


def parts_for(rows: DataFrame, each: int = ROWS) -> int:
    """Partitions of about ``each`` of the ``rows`` (of a table, whose files know their number), one a core at least."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs ``text`` with the driver tables that it names after FROM or JOIN.

    The tables are views of names of their own until the statement is resolved,
    so the session's views stay as they are.
    """
    if OUTLINE in text:
        # The same statement, its documents dealt by the number of lines; the windows by document keep to that.
        parts = parts_for(table(spark, sf_dir, "lineitem"))
        text = text.replace(OUTLINE, OUTLINE.replace("o.o_custkey", "l.o_custkey").replace(_JOINED, _DEALT.format(parts=parts)))
    views = {}

    def view(m: re.Match) -> str:
        views.setdefault(m[2], f"{m[2]}_{uuid.uuid4().hex}")
        return f"{m[1]}{views[m[2]]}" + ("" if m[3] is not None else f" AS {m[2]}")

    aliased = r"(?=\s+(?:AS\s+)?(?!(?:WHERE|GROUP|JOIN|LEFT|FULL|CROSS|ORDER|UNION|ON|HAVING|WINDOW|EXCEPT|LIMIT)\b)[A-Za-z_])"
    text = re.sub(rf"(\b(?:FROM|JOIN)\s+)({'|'.join(NAMES)})\b({aliased})?", lambda m: view(m), text)
    try:
        for name, own in views.items():
            table(spark, sf_dir, name).createOrReplaceTempView(own)
        return spark.sql(text)
    finally:
        for own in views.values():
            spark.catalog.dropTempView(own)


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, paragraph_index, text``."""
    return sql(spark, sf_dir, OUTLINE)


def doc_lines(documents: DataFrame) -> DataFrame:
    """``doc_id, paragraph_index, text``: the lines of each document's text, null text having none."""
    return documents.selectExpr("doc_id", "posexplode(split(text, '\\n', -1)) AS (paragraph_index, text)")
