"""Typed numbers of paragraphs turned into automatic ones, and the proof that only they went."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup, textnodes

# What is typed before a paragraph of each role; a part's label ends otherwise than the others.
LABELS = {
    "ARTICLE": (r"\d{1,2}\.\d{1,3}",),
    "PARAGRAPH": (r"[A-Z]\.", r"\.\d+"),
    "SUBPARAGRAPH": (r"\d+\.", r"\.\d+"),
    "SUBSUBPARAGRAPH": (r"[a-z]\.", r"\.\d+"),
    "SUBPARAGRAPH_LEVEL_5": (r"\d+\)", r"\.\d+"),
    "SUBPARAGRAPH_LEVEL_6": (r"[a-z]\)", r"\.\d+"),
    "SUBPARAGRAPH_LEVEL_7": (r"\(\d+\)", r"\.\d+"),
    "SUBPARAGRAPH_LEVEL_8": (r"\([a-z]\)", r"\.\d+"),
}
PART_LABEL = r"^((?i:PART)\s+(?:\d+|(?i:[IVXLCDM]+)))(?=[\s:\x{2010}-\x{2015}-]|$)"

TYPED = {"PART": PART_LABEL} | {role: rf"^({'|'.join(labels)})(?=\s|$)" for role, labels in LABELS.items()}
#: Any of these labels, and a capital with a bracket, which is no role's.
ANY = rf"^(?:{'|'.join(dict.fromkeys([x for labels in LABELS.values() for x in labels] + [r'[A-Z][)]']))})(?=\s|$)"

_TRACKED = r"<w:(?:ins|del|moveFrom|moveTo|instrText|fldChar|fldSimple)\b"
_BEFORE_NUMBER = re.compile(r"(?:\s*<w:(?:pStyle|keepNext|keepLines|pageBreakBefore|framePr|widowControl)\b[^>]*/>)*")
_NUMBER = r"(?s)<w:numPr\b(?:[^>]*/>|.*?</w:numPr>)"
_STEP = re.compile(r"<w:(tab|br|cr)\b[^>]*/>")
_HEAD = re.compile(r"<w:p(?:\s[^>]*)?>")


def typed_marker(role: Column, text: Column) -> Column:
    """The marker that is typed before a paragraph of this role; null without one."""
    return F.coalesce(*[F.when(role == r, F.nullif(F.regexp_extract(text, p, 1), F.lit(""))) for r, p in TYPED.items()])


def _body(role: Column, text: Column, marker: Column) -> Column:
    rest = F.substr(text, F.length(marker) + 1)
    return F.when(role == "PART", F.regexp_replace(rest, r"^[\s:\x{2010}-\x{2015}-]+", "")).otherwise(F.ltrim(rest))


def planned(marked: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with ``xml, start, end, marker, body, code`` of its paragraphs.

    ``wanted``: ``path, paragraph_index, role, automatic`` (numbered already),
    ``num_id, level`` (the list that shall number it).  ``code`` is null where
    the change can be made; else ``out_of_range``, ``protected`` (in a table,
    with a section, drawing or text box), ``unnumbered`` (nothing typed,
    nothing automatic: left as it is), ``other_marker``, ``doubled`` (typed and
    automatic) or ``tracked`` (changes or fields in the paragraph).
    """
    rows = wanted.join(marked, ["path", "paragraph_index"], "left").withColumn("text", markup.visible_text(F.col("xml")))
    marker = typed_marker(F.col("role"), F.col("text"))
    rows = rows.withColumn("marker", marker)
    other = F.col("marker").isNull() & F.col("text").rlike(ANY)
    automatic = F.coalesce("automatic", F.lit(False))
    code = (
        F.when(F.col("xml").isNull(), "out_of_range").when(F.expr("in_table OR has_section OR has_drawing OR has_textbox"), "protected")
        .when(other, "other_marker").when(F.col("marker").isNotNull() & automatic, "doubled").when(F.col("marker").isNull() & ~automatic, "unnumbered")
        .when(F.col("xml").rlike(_TRACKED), "tracked")
    )
    body = F.when(F.col("marker").isNull(), F.col("text")).otherwise(_body(F.col("role"), F.col("text"), F.col("marker")))
    return rows.select("path", "paragraph_index", "role", "num_id", "level", "xml", "start", "end", "marker", body.alias("body"), code.alias("code"))


def _numbered(xml: str, num_id: str, level: str) -> str:
    number = f"<w:numPr><w:ilvl w:val={quoteattr(level)}/><w:numId w:val={quoteattr(num_id)}/></w:numPr>"
    own = re.match(r"(<w:p(?:\s[^>]*)?>\s*<w:pPr(?:\s[^>]*)?)(?:/>|>(.*?)</w:pPr>)", xml, re.S)
    if not own:
        head = _HEAD.match(xml)
        return f"{xml[: head.end()]}<w:pPr>{number}</w:pPr>{xml[head.end() :]}"
    inner = re.sub(_NUMBER, "", own[2] or "")
    at = _BEFORE_NUMBER.match(inner).end()
    return f"{own[1]}>{inner[:at]}{number}{inner[at:]}</w:pPr>{xml[own.end() :]}"


def _unmarked(xml: str, marker: str, role: str) -> tuple[str | None, str | None]:
    """The paragraph without its marker and the tab behind it, or why not."""
    own = textnodes.nodes(xml)
    letters = r"\s+".join(map(re.escape, marker.split()))
    found = re.match(rf"\s*{letters}[ \t\u00a0{':‐-―-' if role == 'PART' else ''}]*", "".join(t for _, t, _ in own))
    if not found:
        return None, "no_place"
    end = found.end()
    node = next(i for i, (_, t, at) in enumerate(own) if at < end <= at + len(t))
    if end == own[node][2] + len(own[node][1]):
        stop = own[node + 1][0].start() if node + 1 < len(own) else len(xml)
        step = _STEP.search(xml, own[node][0].end(), stop)
        if step and step[1] != "tab":
            return None, "line_break"
        if step:
            xml = xml[: step.start()] + xml[step.end() :]
    return textnodes.replaced(xml, 0, end), None


def _convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            xml, code = (r.xml, None) if r.marker is None else _unmarked(r.xml, r.marker, r.role)
            rows.append((r.path, r.paragraph_index, r.start, r.end, None if code else _numbered(xml, r.num_id, r.level), r.body, code))
        yield pd.DataFrame(rows, columns=["path", "paragraph_index", "start", "end", "xml", "body", "code"])


def edits(plan: DataFrame) -> DataFrame:
    """``path, paragraph_index, start, end, xml, body, code`` of what ``planned`` allows, for ``restyle.spliced`` where ``code`` is null.

    Marker, white space behind it and a tab right after it go, wherever runs
    part them; the list's number comes into the properties.  ``code`` is
    ``line_break`` where a break follows the marker, ``no_place`` where its
    letters are not in the paragraph's own text nodes; these have no ``xml``.
    """
    return plan.where("code IS NULL").mapInPandas(_convert, "path string, paragraph_index long, start long, end long, xml string, body string, code string")


def _skeleton(xml: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(xml, r"(?s)<w:t(?:\s[^>]*)?(?<!/)>.*?</w:t>", "<w:t/>"), _NUMBER, "")
    return F.regexp_replace(F.regexp_replace(bare, r"<w:tab\b[^>]*/>", ""), r"<w:pPr(?:\s[^>]*)?(?:/>|></w:pPr>)", "")


def drift(plan: DataFrame, changed: DataFrame) -> DataFrame:
    """``path, paragraph_index, code`` of edits that changed more than the number: ``text`` or ``markup``; empty means proven."""
    both = changed.where("code IS NULL").select("path", "paragraph_index", F.col("xml").alias("after"), "body").join(plan.select("path", "paragraph_index", "xml"), ["path", "paragraph_index"])
    code = F.when(markup.visible_text(F.col("after")) != F.col("body"), "text").when(_skeleton(F.col("after")) != _skeleton(F.col("xml")), "markup")
    return both.select("path", "paragraph_index", code.alias("code")).where("code IS NOT NULL")
