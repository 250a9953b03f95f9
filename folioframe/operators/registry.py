"""What a template tells: per role a style, an exemplar and where its numbering comes from; styles made of exemplars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup

# First words that number a text by hand.
FIRST_WORDS = ("[0-9]+[.][0-9]+", "[a-z][.]", "[0-9]+[.]", "[.][0-9]+", "[(][0-9]+[)]", "[(][a-z]+[)]", "[ivxlcdm]+[.)]")
NOT_TAKEN = ("pStyle", "numPr", "sectPr", "pPrChange", "rPr")


def by_hand(text: Column) -> Column:
    """Whether a number is typed before a text: as its first word, or behind PART or SECTION, with white space after it (but for a part's)."""
    words = F.split(F.lower(F.regexp_replace(F.ltrim(text), r"\s+", " ")), " ")
    first, second = (F.coalesce(F.get(words, F.lit(i)), F.lit("")) for i in (0, 1))
    numbered = first.rlike(f"^(?:{'|'.join(FIRST_WORDS)})$") & (F.size(words) > 1)
    return F.coalesce(numbered | ((first == "part") & second.rlike(r"^[0-9]+\b")) | ((first == "section") & second.rlike("^[0-9]+[-:]?$") & (F.size(words) > 2)), F.lit(False))


def entries(exemplars: DataFrame, profile: DataFrame, style_numbering: DataFrame) -> DataFrame:
    """``path, role, style_id, paragraph_index, provenance, num_id, level``: one row a role.

    ``exemplars``: ``path, role, paragraph_index`` and the ``style_id`` given to
    the role; of a role given twice the first paragraph counts.  ``profile``:
    ``scanning.paragraph_profile``.  ``style_numbering``: ``path, style_id,
    num_id, level`` after inheritance.  Numbering is ``direct_numpr`` where the
    exemplar states it, else ``style_numpr``, else ``text_literal`` where a
    number is typed, else ``none``; an exemplar that is no paragraph is ``none``.
    """
    one = exemplars.groupBy("path", "role").agg(F.min_by(F.struct("paragraph_index", "style_id"), "paragraph_index").alias("e")).select("path", "role", "e.*")
    told = one.join(profile.select("path", "paragraph_index", "text", "hints"), ["path", "paragraph_index"], "left")
    told = told.join(style_numbering.select("path", "style_id", F.col("num_id").alias("s_num"), F.col("level").alias("s_level")), ["path", "style_id"], "left")
    direct, styled = F.coalesce("hints.num_id", "hints.level").isNotNull(), F.coalesce("s_num", "s_level").isNotNull()
    provenance = F.when(direct, "direct_numpr").when(styled, "style_numpr").when(by_hand(F.col("text")), "text_literal").otherwise("none")
    number = F.when(direct | styled, F.coalesce("hints.num_id", "s_num"))
    return told.select("path", "role", "style_id", "paragraph_index", provenance.alias("provenance"), number.alias("num_id"), F.when(direct | styled, F.coalesce("hints.level", "s_level", F.lit("0"))).alias("level"))


def derived_styles(marked: DataFrame, wanted: DataFrame) -> DataFrame:
    """``path, style_id, xml``: a paragraph style with an exemplar's own formatting.

    ``wanted``: ``path, paragraph_index, style_id, name``, and ``base``, the
    style of exemplars that state none (null for no base).  Only run properties
    that all visible runs share are taken; style, numbering and section are not.
    """
    rows = wanted.join(marked.select("path", "paragraph_index", "xml"), ["path", "paragraph_index"])
    escaped = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    inner = markup.paragraph_properties(F.col("xml"))
    for tag in NOT_TAKEN:
        inner = F.regexp_replace(inner, rf"(?s)<w:{tag}\b(?:[^>]*/>|[^>]*>.*?</w:{tag}>)", "")
    shared = F.array_join(F.transform(markup.uniform_run_properties(F.col("xml")), lambda s: F.concat(F.lit("<"), s, F.lit("/>"))), "")
    base = F.coalesce(markup.value(markup.paragraph_properties(F.col("xml")), "pStyle"), escaped(F.col("base")))
    part = lambda tag, x: F.when(F.trim(x) != "", F.concat(F.lit(f"<w:{tag}>"), x, F.lit(f"</w:{tag}>"))).otherwise("")
    xml = F.concat(
        F.lit('<w:style w:type="paragraph" w:customStyle="1" w:styleId="'), escaped(F.col("style_id")), F.lit('"><w:name w:val="'), escaped(F.coalesce("name", "style_id")), F.lit('"/>'),
        F.coalesce(F.concat(F.lit('<w:basedOn w:val="'), base, F.lit('"/>')), F.lit("")), F.lit("<w:qFormat/>"), part("pPr", inner), part("rPr", shared), F.lit("</w:style>"),
    )
    return rows.select("path", "style_id", xml.alias("xml"))


def inserted_styles(package_parts: DataFrame, known: DataFrame, blocks: DataFrame) -> DataFrame:
    """``path, part, content`` of style sheets with ``blocks`` (``path, style_id, xml``) behind their own styles.

    ``known``: ``definitions.styles``; a style that a sheet has already is not
    put in again, of a block given twice the least text is.
    """
    new = blocks.join(known.select("path", "style_id"), ["path", "style_id"], "left_anti").groupBy("path", "style_id").agg(F.min("xml").alias("xml"))
    per = new.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("style_id", "xml"))), lambda s: s["xml"]), "").alias("more"))
    sheets = package_parts.where("part = 'word/styles.xml'").join(per, "path").select("path", "part", markup.decoded(F.col("content")).alias("text"), "more")
    return sheets.select("path", "part", markup.encoded(F.replace("text", F.lit("</w:styles>"), F.concat("more", F.lit("</w:styles>")))).alias("content"))
