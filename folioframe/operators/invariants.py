"""What an application must leave as it is, as evidence of a package before and after."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..session import cut
from ..sources import definitions, scanning
from . import bags, shells

KINDS = ("section", "layout", "shell", "list", "media", "runs", "links", "part")

# Section properties that a template's page layout may set.
LAYOUT = ("pgSz", "pgMar", "cols", "titlePg", "docGrid", "vAlign", "pgBorders", "pgNumType", "lnNumType", "textDirection", "bidi")
#: Parts that an application writes anew; each has evidence of a kind of its own.
WRITTEN = ("word/document.xml", "word/styles.xml", "word/numbering.xml", "word/_rels/document.xml.rels", "[Content_Types].xml")


def _told(frame: DataFrame, kind: str, owner: Column, value: Column, place: Column) -> DataFrame:
    return frame.select("path", F.lit(kind).alias("kind"), owner.cast("string").alias("owner"), value.cast("string").alias("value"), place.cast("long").alias("place"))


def _sections(package_parts: DataFrame) -> DataFrame:
    """``path, section_index, xml`` of the section properties outside tables, drawings and text boxes."""
    apart = r"(?s)<w:(tbl|drawing|pict|object|txbxContent)\b.*?</w:\1>"
    found = scanning.main_text(package_parts).select("path", F.regexp_extract_all(F.regexp_replace("text", apart, ""), F.lit(r"(?s)(<w:sectPr\b(?:[^>]*/>|.*?</w:sectPr>))"), 1).alias("all"))
    return found.select("path", F.posexplode("all").alias("section_index", "xml"))


def evidence(package_parts: DataFrame) -> DataFrame:
    """``path, kind, owner, value, place``: the protected structures of sound packages, each as an ordered bag of values.

    ``section``: each section's properties but layout and references; ``layout``:
    its page layout; ``shell``: the digest of the header or footer that each
    section shows, by kind and type; ``list``: every list definition and
    instance; ``media``: the digest of each picture; ``runs``: each paragraph's
    runs with their own properties; ``links``: the main part's relationships;
    ``part``: the digest of every part that is not written anew.
    """
    sound = package_parts.where("fault IS NULL")
    named = "|".join(LAYOUT)
    pieces = _sections(sound).select("path", "section_index", markup.canonical(F.col("xml")).alias("xml"))
    layout = F.regexp_extract_all("xml", F.lit(rf"(?s)(<w:(?:{named})\b(?:[^>]*/>|[^>]*>.*?</w:(?:{named})>))"), 1)
    rest = F.regexp_replace(F.regexp_replace("xml", rf"(?s)<w:(?:{named})\b(?:[^>]*/>|[^>]*>.*?</w:(?:{named})>)", ""), r"<w:(?:header|footer)Reference\b[^>]*/>", "")
    shown = cut(shells.shown_parts(sound)).drop("kind")
    contents = sound.select("path", "part", F.sha2("content", 256).alias("sha"))
    refs = definitions.header_footer_refs(sound).where("rel_id IS NOT NULL").join(shown, ["path", "rel_id"], "left").join(contents, ["path", "part"], "left")
    lists = shells.list_blocks(sound)
    runs = scanning.paragraph_markup(sound).select("path", "paragraph_index", F.posexplode(F.transform(markup.runs(F.col("xml")), lambda r: markup.canonical(markup.run_properties(r)))).alias("at", "own"))
    rels = definitions.relationships(sound).where(F.col("part") == "word/_rels/document.xml.rels")
    return reduce(
        DataFrame.unionByName,
        [
            _told(pieces, "section", F.col("section_index"), rest, F.lit(0)),
            _told(pieces.select("path", "section_index", F.posexplode(layout).alias("at", "x")), "layout", F.col("section_index"), F.col("x"), F.col("at")),
            _told(refs, "shell", F.concat_ws("/", F.col("section_index").cast("string"), "kind", "type"), F.coalesce("sha", F.lit("missing")), F.lit(0)),
            _told(lists, "list", F.col("kind"), markup.canonical(F.col("xml")), F.col("id")),
            _told(contents.where("part LIKE 'word/media/%'"), "media", F.lit("media"), F.col("sha"), F.lit(0)),
            _told(runs, "runs", F.col("paragraph_index"), F.coalesce("own", F.lit("")), F.col("at")),
            _told(rels, "links", F.col("rel_id"), F.concat_ws(" ", "type", "target"), F.lit(0)),
            _told(contents.where(~F.col("part").isin(*WRITTEN)), "part", F.col("part"), F.col("sha"), F.lit(0)),
        ],
    )


def violations(before: DataFrame, after: DataFrame, allowed: DataFrame | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``path, kind, owner, change, value, n``: what differs between two ``evidence`` tables and was not allowed.

    ``allowed``: ``path, kind, owner`` that may change (a null owner: all of the
    kind; a null path: of all packages).  Empty means proven.
    """
    some = lambda df: df.where(F.col("kind").isin(*kinds))
    found = bags.differences(some(before), some(after), ["path", "kind", "owner"])
    if allowed is None:
        return found
    free = allowed.select(F.col("path").alias("p"), F.col("kind").alias("k"), F.col("owner").alias("o"))
    met = (F.col("kind") == F.col("k")) & (F.col("p").isNull() | (F.col("p") == F.col("path"))) & (F.col("o").isNull() | (F.col("o") == F.col("owner")))
    return found.join(free, met, "left_anti")
