"""Styles, numbering and relationships of Word packages as tables.

Each reader takes ``packages.parts`` and opens one part per task row; what the
definitions mean to a paragraph is worked out by joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _val(node: ElementTree.Element, *steps: str) -> str | None:
    found = node.find("/".join(f"{_W}{s}" for s in steps))
    return None if found is None else found.get(f"{_W}val")


def _style_rows(root: ElementTree.Element) -> Iterator[tuple]:
    for s in root.iter(f"{_W}style"):
        yield (s.get(f"{_W}styleId"), s.get(f"{_W}type"), _val(s, "name"), _val(s, "basedOn"), _val(s, "next"), _val(s, "link"), s.get(f"{_W}default") in ("1", "true", "on"), _val(s, "pPr", "numPr", "numId"), _val(s, "pPr", "numPr", "ilvl"), s.get(f"{_W}customStyle") in ("1", "true", "on"), _val(s, "uiPriority"), *(bool(_on(s, x)) for x in ("qFormat", "semiHidden", "unhideWhenUsed", "locked")))


def _on(node: ElementTree.Element, name: str) -> bool | None:
    """Whether an on-off property is on; None where it is absent."""
    found = node.find(f"{_W}{name}")
    return None if found is None else (found.get(f"{_W}val") or "true").lower() not in ("0", "false", "off", "none")


def _level(owner: str | None, node: ElementTree.Element, kind: str) -> tuple:
    return (kind, owner, None, node.get(f"{_W}ilvl"), _val(node, "start"), _val(node, "numFmt"), _val(node, "lvlText"), _val(node, "lvlRestart"), _val(node, "suff"), _on(node, "isLgl"), _val(node, "pStyle"))


def _numbering_rows(root: ElementTree.Element) -> Iterator[tuple]:
    for a in root.iter(f"{_W}abstractNum"):
        yield from (_level(a.get(f"{_W}abstractNumId"), lvl, "level") for lvl in a.iter(f"{_W}lvl"))
    for n in root.iter(f"{_W}num"):
        own = n.get(f"{_W}numId")
        yield ("num", own, _val(n, "abstractNumId"), None, None, None, None, None, None, None, None)
        for o in n.iter(f"{_W}lvlOverride"):
            lvl = o.find(f"{_W}lvl")
            _, _, _, _, start, *rest = _level(own, o if lvl is None else lvl, "override")
            yield ("override", own, None, o.get(f"{_W}ilvl"), _val(o, "startOverride") or start, *rest)


def _relationship_rows(root: ElementTree.Element) -> Iterator[tuple]:
    for r in root.iter(f"{_R}Relationship"):
        yield (r.get("Id"), r.get("Type"), r.get("Target"), r.get("TargetMode") == "External")


def _read(package_parts: DataFrame, where: Column, rows: Callable, fields: str) -> DataFrame:
    """``path, part`` and ``fields`` of each row that ``rows`` yields for a part's root."""
    schema = f"path string, part string, {fields}"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, part, content in batch.itertuples(index=False):
                yield pd.DataFrame([(path, part, *r) for r in rows(ElementTree.fromstring(content))], columns=names, dtype=object)

    return package_parts.where(where).select("path", "part", "content").mapInPandas(run, schema)


def styles(package_parts: DataFrame) -> DataFrame:
    """One row per style definition, in any order."""
    return _read(package_parts, F.col("part") == "word/styles.xml", _style_rows, "style_id string, type string, name string, based_on string, next string, link string, is_default boolean, num_id string, level string, is_custom boolean, ui_priority string, quick boolean, hidden boolean, unhide boolean, locked boolean").drop("part")


def table_styles(package_parts: DataFrame) -> DataFrame:
    """The ``styles`` of tables."""
    return styles(package_parts).where("type = 'table'")


def _latent_rows(root: ElementTree.Element) -> Iterator[tuple]:
    for latent in root.iter(f"{_W}latentStyles"):
        for key, value in latent.attrib.items():
            yield (None, key.removeprefix(_W), value)
        for x in latent.iter(f"{_W}lsdException"):
            yield from ((x.get(f"{_W}name"), key.removeprefix(_W), value) for key, value in x.attrib.items() if key != f"{_W}name")


def latent_styles(package_parts: DataFrame) -> DataFrame:
    """``path, name, attribute, value`` of the latent styles: a null name for what holds for all, else a style's exception."""
    return _read(package_parts, F.col("part") == "word/styles.xml", _latent_rows, "name string, attribute string, value string").drop("part")


def numbering(package_parts: DataFrame) -> DataFrame:
    """``kind`` tells the rows apart: ``num`` (owner, abstract_id), ``level`` of an abstract and ``override`` of a num.

    Levels and overrides have ``start, format, level_text, restart, suffix,
    legal`` and ``style``, the style that they number.
    """
    fields = "kind string, owner string, abstract_id string, level string, start string, format string, level_text string, restart string, suffix string, legal boolean, style string"
    return _read(package_parts, F.col("part") == "word/numbering.xml", _numbering_rows, fields).drop("part")


def numbering_in_use(numbers: DataFrame, used: DataFrame) -> DataFrame:
    """The rows of ``numbering`` that the lists of ``used`` (path, num_id) need: themselves, their overrides, their definitions' levels."""
    wanted = used.select("path", F.col("num_id").alias("owner")).where("owner IS NOT NULL").distinct()
    own = numbers.where("kind IN ('num', 'override')").join(wanted, ["path", "owner"], "left_semi")
    defs = own.where("kind = 'num'").select("path", F.col("abstract_id").alias("owner")).distinct()
    return own.unionByName(numbers.where("kind = 'level'").join(defs, ["path", "owner"], "left_semi"))


def _property_rows(kind: str, owner: str | None, node: ElementTree.Element | None) -> Iterator[tuple]:
    """One row per attribute of each property; a property without attributes says "true"."""
    for prop in () if node is None else node:
        name = prop.tag.removeprefix(_W)
        for key, value in prop.attrib.items():
            yield (kind, owner, name, key.removeprefix(_W), value)
        if not prop.attrib and not len(prop):
            yield (kind, owner, name, "val", "true")


def _default_rows(root: ElementTree.Element) -> Iterator[tuple]:
    for kind in ("rPr", "pPr"):
        yield from _property_rows(kind, None, root.find(f"{_W}docDefaults/{_W}{kind}Default/{_W}{kind}"))


def document_defaults(package_parts: DataFrame) -> DataFrame:
    """``path, kind, property, attribute, value`` of the document defaults; ``kind`` is rPr or pPr."""
    fields = "kind string, owner string, property string, attribute string, value string"
    return _read(package_parts, F.col("part") == "word/styles.xml", _default_rows, fields).drop("part", "owner")


def _style_property_rows(root: ElementTree.Element) -> Iterator[tuple]:
    for s in root.iter(f"{_W}style"):
        for kind in ("rPr", "pPr"):
            yield from _property_rows(kind, s.get(f"{_W}styleId"), s.find(f"{_W}{kind}"))


def style_properties(package_parts: DataFrame) -> DataFrame:
    """``path, kind, style_id, property, attribute, value`` that each style states itself."""
    fields = "kind string, style_id string, property string, attribute string, value string"
    return _read(package_parts, F.col("part") == "word/styles.xml", _style_property_rows, fields).drop("part")


def effective_properties(style_ancestors: DataFrame, stated: DataFrame, defaults: DataFrame) -> DataFrame:
    """``path, style_id, kind, property, attribute, value, origin``: what holds for each style.

    ``style_ancestors`` (path, style_id, node, depth) names each style's line,
    itself at depth 0.  The nearest statement wins, attribute by attribute; the
    document defaults come last.  ``origin`` is the style that states it, null
    for a default.
    """
    key = ["path", "style_id", "kind", "property", "attribute"]
    inherited = style_ancestors.join(stated.withColumnRenamed("style_id", "node"), ["path", "node"]).select(*key, "value", F.col("node").alias("origin"), "depth")
    last = style_ancestors.select("path", "style_id").distinct().join(defaults, "path").select(*key, "value", F.lit(None).cast("string").alias("origin"), F.lit(1 << 30).alias("depth"))
    return inherited.unionByName(last).groupBy(*key).agg(F.min_by(F.struct("value", "origin"), "depth").alias("v")).select(*key, "v.*")


# Elements whose section properties are not the document's own.
_APART = tuple(f"{_W}{x}" for x in ("tbl", "drawing", "pict", "object", "txbxContent"))


def _section_rows(root: ElementTree.Element) -> Iterator[tuple]:
    at, stack = 0, [root]
    while stack:
        node = stack.pop()
        if node.tag == f"{_W}sectPr":
            get = lambda name, key: None if (x := node.find(f"{_W}{name}")) is None else x.get(f"{_W}{key}")  # noqa: B023, E731
            refs = [(x.tag.removeprefix(_W).removesuffix("Reference"), x.get(f"{_W}type") or "default", x.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")) for x in node if x.tag.endswith("Reference")]
            yield (at, get("pgSz", "w"), get("pgSz", "h"), get("pgSz", "orient"), *[get("pgMar", k) for k in ("top", "right", "bottom", "left")], get("cols", "num"), node.find(f"{_W}titlePg") is not None, refs)
            at += 1
        elif not node.tag.startswith(_APART):
            stack += reversed(node)


def sections(package_parts: DataFrame) -> DataFrame:
    """One row per section of the main part, in order: page size, margins, columns, title page, header and footer references.

    Section properties within tables, drawings and text boxes are left out.
    """
    fields = "section_index int, width string, height string, orient string, top string, right string, bottom string, left string, columns string, title_page boolean, refs array<struct<kind:string,type:string,rel_id:string>>"
    return _read(package_parts, F.col("part") == "word/document.xml", _section_rows, fields).drop("part")


def header_footer_refs(package_parts: DataFrame) -> DataFrame:
    """``path, section_index, kind, type, rel_id``: the header or footer part that each section shows.

    One row per section, kind (header, footer) and type (default, first, even)
    that the document names anywhere; a section without a reference of its own
    shows that of the nearest section before it, null if none has one.
    """
    own = sections(package_parts)
    named = own.select("path", "section_index", F.explode("refs").alias("r")).select("path", "section_index", "r.*")
    asked = own.select("path", "section_index").join(named.select("path", "kind", "type").distinct(), "path")
    full = asked.join(named.groupBy("path", "section_index", "kind", "type").agg(F.min("rel_id").alias("rel_id")), ["path", "section_index", "kind", "type"], "left")
    before = Window.partitionBy("path", "kind", "type").orderBy("section_index").rowsBetween(Window.unboundedPreceding, 0)
    return full.withColumn("rel_id", F.last("rel_id", ignorenulls=True).over(before))


def relationships(package_parts: DataFrame) -> DataFrame:
    """``path, part, rel_id, type, target, external, resolved, fault`` of all relationship parts.

    ``resolved`` is the part that an internal target names; ``fault`` tells why
    a target is not followed (``scheme``, ``query``, ``absolute``, ``parent``).
    """
    rels = _read(package_parts, F.col("part").endswith(".rels"), _relationship_rows, "rel_id string, type string, target string, external boolean")
    target = F.url_decode("target")
    fault = (
        F.when(F.col("external"), None).when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "scheme").when(target.rlike("[?#\\\\]"), "query")
        .when(target.startswith("/"), "absolute").when(target.rlike("(^|/)[.][.](/|$)"), "parent")
    )
    home = F.regexp_replace("part", "_rels/[^/]*$", "")
    return rels.withColumn("fault", fault).withColumn("resolved", F.when(~F.col("external") & F.col("fault").isNull(), F.concat(home, F.regexp_replace(target, "^([.]/)+", ""))))


def effective_numbering(paragraphs: DataFrame, style_numbering: DataFrame, numbers: DataFrame) -> DataFrame:
    """Paragraphs with the number format that applies to them.

    ``style_numbering`` (path, style_id, num_id, level) holds what each style
    has after inheritance.  A paragraph's own values win key by key; numId
    "0" or none means no numbering and a missing level is "0".  A num's
    override wins over its abstract's level, key by key.
    """
    key = ["path"]
    of_style = style_numbering.select(*key, F.col("style_id").alias("style"), F.col("num_id").alias("s_num"), F.col("level").alias("s_level"))
    own = paragraphs.join(of_style, [*key, "style"], "left")
    own = own.withColumn("num", F.nullif(F.coalesce("num_id", "s_num"), F.lit("0"))).withColumn("lvl", F.when(F.col("num").isNotNull(), F.coalesce("level", "s_level", F.lit("0"))))
    nums = numbers.where("kind = 'num'").select(*key, F.col("owner").alias("num"), "abstract_id")
    levels = numbers.where("kind = 'level'").select(*key, F.col("owner").alias("abstract_id"), F.col("level").alias("lvl"), F.struct("start", "format", "level_text").alias("base"))
    over = numbers.where("kind = 'override'").select(*key, F.col("owner").alias("num"), F.col("level").alias("lvl"), F.struct("start", "format", "level_text").alias("over"))
    joined = own.join(nums, [*key, "num"], "left").join(levels, [*key, "abstract_id", "lvl"], "left").join(over, [*key, "num", "lvl"], "left")
    pick = [F.coalesce(f"over.{x}", f"base.{x}").alias(x) for x in ("start", "format", "level_text")]
    return joined.select(*key, "paragraph_index", "text", "style", F.col("num").alias("num_id"), F.col("lvl").alias("level"), *pick)


def section_inheritance(sections: DataFrame, doc: str, kind: str, order: str, ref: str) -> DataFrame:
    """``ref`` taken from the nearest earlier section that has one of the same kind."""
    before = Window.partitionBy(doc, kind).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return sections.withColumn(ref, F.last(ref, ignorenulls=True).over(before))
