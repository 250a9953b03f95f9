"""Children of two elements merged in the order that a schema prescribes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order of the children of section properties.
SECTION_ORDER = (
    "headerReference", "footerReference", "footnotePr", "endnotePr", "type", "pgSz", "pgMar", "paperSrc", "pgBorders", "lnNumType", "pgNumType",
    "cols", "formProt", "vAlign", "noEndnote", "titlePg", "textDirection", "bidi", "rtlGutter", "docGrid", "printerSettings", "sectPrChange",
)


def merged_children(target: Column, source: Column, managed: list[str], order: tuple[str, ...] = SECTION_ORDER) -> Column:
    """``target`` (array of struct tag, xml) with its ``managed`` children replaced by those of ``source``.

    A managed child of the source, the first of its tag, comes before the first
    remaining child that ``order`` puts behind it, else to the end; children of
    the same place stand in ``order``.  Children that ``order`` doesn't know stay
    beside their neighbours.  Null arrays are empty ones.
    """
    none = F.array().cast("array<struct<tag: string, xml: string>>")
    names = F.array(*map(F.lit, order))
    wanted = F.array(*map(F.lit, [t for t in order if t in managed]))
    kept = F.filter(F.coalesce(target, none), lambda c: ~F.coalesce(c["tag"].isin(*managed), F.lit(False)))
    rank = lambda tag: F.array_position(names, tag)  # noqa: E731  0 for one that is not known
    new = F.filter(F.transform(wanted, lambda t: F.get(F.filter(F.coalesce(source, none), lambda c: c["tag"] == t), F.lit(0))), lambda c: c.isNotNull())
    behind = lambda c: F.array_position(F.transform(kept, lambda k: rank(F.coalesce(k["tag"], F.lit(""))) > rank(c["tag"])), True)
    spot = lambda c: F.when(behind(c) > 0, behind(c) - 1).otherwise(F.size(kept).cast("long"))
    placed = F.transform(new, lambda c: F.struct(spot(c).alias("at"), F.lit(0).alias("kind"), rank(c["tag"]).alias("rank"), c["tag"].alias("tag"), c["xml"].alias("xml")))
    own = F.transform(kept, lambda c, i: F.struct(i.cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("rank"), c["tag"].alias("tag"), c["xml"].alias("xml")))
    return F.transform(F.array_sort(F.concat(placed, own)), lambda c: F.struct(c["tag"].alias("tag"), c["xml"].alias("xml")))
