"""Roles told by automatic numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of number formats, and the roles of the levels of one proven list.
DECIMAL, UPPER, LOWER = ("decimal", "decimalzero"), ("upperletter", "upperalpha"), ("lowerletter", "loweralpha")
#: Level texts of a list's first levels, in a proven ladder and under a part alone (fixed values, too).
FIRST_LEVEL, SECOND_LEVEL, PART_LEVEL = r"(?i)^\s*(?:PART\s+)?%1\s*\.?\s*$", r"^\s*%1\s*\.\s*%2\s*$", r"(?i)^\s*PART\s+%1\s*[-\x{2010}-\x{2015}:]?\s*$"
LEVEL_ROLES = ("PART", "ARTICLE", "PARAGRAPH", "SUBPARAGRAPH", "SUBSUBPARAGRAPH", "SUBPARAGRAPH_LEVEL_5", "SUBPARAGRAPH_LEVEL_6", "SUBPARAGRAPH_LEVEL_7", "SUBPARAGRAPH_LEVEL_8")


def _format(fmt: Column) -> Column:
    return F.lower(F.trim(F.coalesce(fmt, F.lit(""))))


def _own(before: str, level: Column, after: str) -> Column:
    """A pattern for the placeholder of a level itself between two patterns."""
    return F.concat(F.lit(before + "%"), (level + 1).cast("string"), F.lit(after))


def role_of_signature(fmt: Column, text: Column, level: Column) -> Column:
    """The role that one level's number format and text give by themselves; null where they don't tell.

    Null format and text count as empty, a null level fits no rule that asks
    for one.  The first rule that fits counts.
    """
    f, t = _format(fmt), F.coalesce(text, F.lit(""))
    decimal, lower = f.isin(*DECIMAL), f.isin(*LOWER)
    places = F.regexp_count(t, F.lit("%[0-9]+"))
    closed = F.coalesce(F.rlike(t, _own(r"^\s*", level, r"\s*\)\s*$")), F.lit(False))
    wrapped = F.coalesce(F.rlike(t, _own(r"^\s*\(\s*", level, r"\s*\)\s*$")), F.lit(False))
    return (
        F.when(F.contains(F.upper(t), F.lit("PART")), "PART")
        .when((places == 2) & level.isin(0, 1) & decimal & t.rlike(r"^\s*%\d+\s*\.\s*%\d+\s*$"), "ARTICLE")
        .when(closed & decimal & (level >= 3), "SUBPARAGRAPH_LEVEL_5")
        .when(closed & lower & (level >= 4), "SUBPARAGRAPH_LEVEL_6")
        .when(wrapped & decimal & (level >= 5), "SUBPARAGRAPH_LEVEL_7")
        .when(wrapped & lower & (level >= 6), "SUBPARAGRAPH_LEVEL_8")
        .when(f.isin(*UPPER), "PARAGRAPH")
        .when(lower, "SUBSUBPARAGRAPH")
        .when((f == "decimal") & t.rlike(r"^\s*\.\s*%\d+"), F.when(level == 0, "PARAGRAPH").when(level == 1, "SUBPARAGRAPH"))
        .when(decimal & (places <= 1) & (level >= 2), "SUBPARAGRAPH")
    )


def list_roles(levels: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, level, role``: the roles of a list's levels, its other levels taken into account.

    ``levels``: ``keys`` of the list, ``level`` from 0, ``format``,
    ``level_text``, a row a level.  A level's own signature decides first.  Else
    a level below a part that combines the part's number with its own is an
    article; and where levels 0, 1 and 2 are a part, an article and a dotted
    number and all down to the level go on so, the place decides.  Levels
    beyond 8 and null ones get no role.
    """
    level, t = F.col("level"), F.coalesce("level_text", F.lit(""))
    decimal = _format(F.col("format")).isin(*DECIMAL)
    whole = Window.partitionBy(*keys)

    def proven(at: int, told: Column) -> Column:
        return F.coalesce(F.max(F.when(level == at, told)).over(whole), F.lit(False))

    dotted = decimal & F.rlike(t, _own(r"^\s*\.\s*", level, r"\s*$"))
    ladder = proven(0, decimal & t.rlike(FIRST_LEVEL)) & proven(1, decimal & t.rlike(SECOND_LEVEL)) & proven(2, dotted)
    steps = F.sum(F.when((level >= 2) & dotted, 1).otherwise(0)).over(whole.orderBy("level").rowsBetween(Window.unboundedPreceding, 0))
    under_part = proven(0, decimal & t.rlike(PART_LEVEL))
    article = under_part & (level >= 2) & decimal & F.rlike(t, _own(r"^\s*%1\s*\.\s*", level, r"\s*$"))
    by_place = F.get(F.array(*map(F.lit, LEVEL_ROLES)), level)
    role = F.coalesce(role_of_signature(F.col("format"), t, level), F.when(article, "ARTICLE"), F.when(ladder & ((level < 2) | (steps == level - 1)), by_place))
    return levels.select(*keys, "level", F.when(level.between(0, 8), role).alias("role"))
