"""Styles put on paragraphs of Word packages, and the proof of what that changed.

What is to change is worked out by joins; each task rewrites the paragraphs of
its rows, and one task splices a package's main part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..session import cut
from ..sources import scanning

# What each mode does, and the properties that a style never takes over.
POLICIES = {
    "format_only": {"preserve_numbering": True, "convert": False, "import_numbering": False},
    "convert": {"preserve_numbering": False, "convert": True, "import_numbering": True},
}
KEPT_OF_RUNS = ("rStyle", "rPrChange")
KEPT_OF_PARAGRAPHS = ("pStyle", "numPr", "ilvl", "numId", "sectPr", "pPrChange", "cnfStyle")

_OPEN = re.compile(r"<w:p((?:\s[^>]*?)?)(/?)>")
_PROPERTIES = re.compile(r"\s*<w:pPr(?:\s[^>]*?)?(?:/>|>(.*?)</w:pPr>)", re.S)
_RUN_PROPERTIES = re.compile(r"(<w:rPr(?:\s[^>]*)?(?<!/)>)(.*?)(</w:rPr>)", re.S)


def _without(inner: str, names: list[str]) -> str:
    if not names:
        return inner
    return re.sub(rf"<w:({'|'.join(map(re.escape, names))})(?:\s[^>]*)?(?:/>|(?<!/)>.*?</w:\1>)", "", inner, flags=re.S)


def _restyled(xml: str, style: str, of_paragraph: list[str], of_runs: list[str]) -> str:
    head = _OPEN.match(xml)
    own = None if head[2] else _PROPERTIES.match(xml, head.end())
    inner = (own[1] or "") if own else ""
    inner = _without(re.sub(r"<w:pStyle\b[^>]*/>", "", inner), of_paragraph)
    body = "" if head[2] else xml[own.end() if own else head.end() : -len("</w:p>")]
    body = _RUN_PROPERTIES.sub(lambda m: m[1] + _without(m[2], of_runs) + m[3], body)
    return f"<w:p{head[1]}><w:pPr><w:pStyle w:val={quoteattr(style)}/>{inner}</w:pPr>{body}</w:p>"


def _rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        made = [_restyled(x, s, list(p), list(r)) for x, s, p, r in zip(b["xml"], b["new_style"], b["of_paragraph"], b["of_runs"])]
        yield b[["path", "paragraph_index", "start", "end"]].assign(xml=made)


def edits(marked: DataFrame, assigned: DataFrame) -> DataFrame:
    """``path, paragraph_index, start, end, xml``: the paragraphs as they shall be.

    ``assigned``: ``path, paragraph_index, new_style`` and the names that the
    style supplies, ``supplied_paragraph`` and ``supplied_run`` (arrays; null
    counts as empty).  Direct properties of these names leave, but for the
    kinds in KEPT_OF_PARAGRAPHS and KEPT_OF_RUNS.  Paragraphs in tables and
    with sections, drawings or text boxes are left alone.
    """

    def names(col: str, kept: tuple[str, ...]) -> Column:
        return F.array_except(F.coalesce(col, F.array().cast("array<string>")), F.array(*map(F.lit, kept)))

    open_rows = marked.where("NOT (in_table OR has_section OR has_drawing OR has_textbox)").select("path", "paragraph_index", "start", "end", "xml")
    rows = open_rows.join(assigned, ["path", "paragraph_index"]).select(
        "path", "paragraph_index", "start", "end", "xml", "new_style", names("supplied_paragraph", KEPT_OF_PARAGRAPHS).alias("of_paragraph"), names("supplied_run", KEPT_OF_RUNS).alias("of_runs")
    )
    return rows.mapInPandas(_rewrite, "path string, paragraph_index long, start long, end long, xml string")


def _splice(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = []
        for text, changes in zip(batch["text"], batch["changes"]):
            out, at = [], 0
            for c in changes:
                out += [text[at : c["start"]], c["xml"]]
                at = c["end"]
            made.append("".join([*out, text[at:]]))
        yield batch[["path"]].assign(text=made)


def spliced(package_parts: DataFrame, changed: DataFrame) -> DataFrame:
    """``path, part, content``: the main parts with the paragraphs of ``edits`` in place, every other letter as it was."""
    per = changed.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end", "xml"))).alias("changes"))
    texts = scanning.main_text(package_parts).join(per, "path").mapInPandas(_splice, "path string, text string")
    return texts.select("path", F.lit("word/document.xml").alias("part"), markup.encoded(F.col("text")).alias("content"))


def _evidence(marked: DataFrame) -> DataFrame:
    runs = F.flatten(F.transform(markup.runs(F.col("xml")), lambda r: markup.property_names(markup.run_properties(r))))
    return marked.select("path", "paragraph_index", markup.visible_text(F.col("xml")).alias("text"), "in_table", "has_section", "has_drawing", "has_textbox", markup.property_names(markup.paragraph_properties(F.col("xml"))).alias("of_p"), F.array_distinct(runs).alias("of_r"))


def drift(before: DataFrame, after: DataFrame, allowed: DataFrame) -> DataFrame:
    """``path, paragraph_index, code``: what changed between two ``paragraph_markup`` and was not allowed.

    Codes: ``added``, ``removed``, ``text``, ``structure``,
    ``property_added`` (any but pStyle), ``property_removed`` (not among the
    names of ``allowed``, as given to ``edits``).  Empty means proven.
    """
    key = ["path", "paragraph_index"]
    b, a = _evidence(before), _evidence(after)
    both = b.select(*key, F.struct(*b.columns[2:]).alias("b")).join(a.select(*key, F.struct(*a.columns[2:]).alias("a")), key, "full_outer")
    both = both.join(allowed.select(*key, "supplied_paragraph", "supplied_run"), key, "left")
    none = F.array().cast("array<string>")
    lost = F.array_union(
        F.array_except(F.array_except("b.of_p", "a.of_p"), F.array_append(F.coalesce("supplied_paragraph", none), "pStyle")), F.array_except(F.array_except("b.of_r", "a.of_r"), F.coalesce("supplied_run", none))
    )
    gained = F.array_except(F.array_union(F.array_except("a.of_p", "b.of_p"), F.array_except("a.of_r", "b.of_r")), F.array(F.lit("pStyle")))
    flags = ("in_table", "has_section", "has_drawing", "has_textbox")
    code = F.when(F.col("b").isNull(), F.array(F.lit("added"))).when(F.col("a").isNull(), F.array(F.lit("removed"))).otherwise(
        F.array_compact(F.array(
            F.when(F.col("b.text") != F.col("a.text"), "text"), F.when(F.struct(*[f"b.{f}" for f in flags]) != F.struct(*[f"a.{f}" for f in flags]), "structure"),
            F.when(F.size(gained) > 0, "property_added"), F.when(F.size(lost) > 0, "property_removed"),
        ))
    )
    return both.select(*key, F.explode(code).alias("code"))


def closure(styles: DataFrame, needed: DataFrame) -> DataFrame:
    """``path, style_id``: the needed styles and all that they name by basedOn, link or next; cycles are no harm."""
    links = cut(styles.select("path", "style_id", F.explode(F.array_compact(F.array("based_on", "link", "next"))).alias("other")))
    found = fresh = cut(needed.select("path", "style_id").distinct())
    while not fresh.isEmpty():
        fresh = cut(fresh.join(links, ["path", "style_id"]).select("path", F.col("other").alias("style_id")).distinct().join(found, ["path", "style_id"], "left_anti"))
        found = found.unionByName(fresh)
    return found.join(styles.select("path", "style_id"), ["path", "style_id"], "left_semi")


def import_names(wanted: DataFrame, target: DataFrame, seed: str = "") -> DataFrame:
    """``style_id, new_id``: names for imported styles; one the target has gets a digest behind it.

    Both tables have ``style_id``.  The digest is of ``seed`` and the name, so
    reruns agree.
    """
    taken = target.select(F.col("style_id").alias("t")).distinct()
    renamed = F.concat_ws("__", "style_id", F.left(F.sha2(F.concat(F.lit(seed), "style_id"), 256), F.lit(10)))
    return wanted.select("style_id").distinct().join(taken, F.col("style_id") == F.col("t"), "left").select("style_id", F.when(F.col("t").isNull(), F.col("style_id")).otherwise(renamed).alias("new_id"))


def merged(target: DataFrame, template: DataFrame, key: str, winner: str, managed: list[str] | None = None) -> DataFrame:
    """Two settings tables with the same columns as one.

    ``winner="target"``: the template only adds keys that are missing.
    ``winner="template"``: it replaces or adds the ``managed`` keys (all if
    None); the target's other rows stay and the template's others are left out.
    """
    if winner == "template":
        base = template if managed is None else template.where(F.col(key).isin(managed))
        return base.unionByName(target.join(base, key, "left_anti").select(*base.columns))
    return target.unionByName(template.join(target, key, "left_anti").select(*target.columns))


def content_type_problems(package_parts: DataFrame) -> DataFrame:
    """``path, code, detail`` of content types: ``type_malformed``, ``type_twice``, ``type_of_nothing`` (declared, not there), ``no_type`` (there, not declared).

    A part's declaration by name counts, letters folded, else its extension's;
    the declarations themselves and trash items need none.
    """
    told = package_parts.where("part = '[Content_Types].xml'").select("path", markup.decoded(F.col("content")).alias("text"))
    nodes = told.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"<(?:\w+:)?(?:Default|Override)\b[^>]*>"), 0)).alias("x"))
    named = lambda a: F.nullif(F.regexp_extract("x", rf'\b{a}="([^"]*)"', 1), F.lit(""))
    given = cut(nodes.select("path", F.col("x").rlike("Override").alias("one"), named("Extension").alias("ext"), named("PartName").alias("part"), named("ContentType").alias("type")))
    key = F.when(F.col("one"), F.lower(F.regexp_replace(F.url_decode("part"), "^/", ""))).otherwise(F.concat(F.lit("*."), F.lower("ext")))
    bad = F.col("type").isNull() | (F.col("one") & ~F.coalesce(F.col("part").startswith("/") & ~F.col("part").rlike("(^|/)[.][.](/|$)"), F.lit(False))) | (~F.col("one") & F.col("ext").isNull())
    malformed = given.where(bad).select("path", F.lit("type_malformed").alias("code"), F.coalesce("part", "ext", F.lit("")).alias("detail"))
    sound = cut(given.where(~bad).select("path", "one", key.alias("key")))
    twice = sound.groupBy("path", "key").count().where("count > 1").select("path", F.lit("type_twice").alias("code"), F.col("key").alias("detail"))
    have = cut(package_parts.where("part IS NOT NULL").select("path", "part", F.lower("part").alias("key")))
    nothing = sound.where("one").join(have.select("path", "key"), ["path", "key"], "left_anti").select("path", F.lit("type_of_nothing").alias("code"), F.col("key").alias("detail")).distinct()
    lower = have.where("part <> '[Content_Types].xml'").where(~F.col("part").rlike(r"^\[trash\]/[0-9A-Fa-f]{4}\.dat$"))
    by_end = lower.withColumn("end", F.concat(F.lit("*."), F.regexp_extract("key", r"[.]([^./]*)$", 1)))
    free = by_end.join(sound.select("path", "key"), ["path", "key"], "left_anti").join(sound.select("path", F.col("key").alias("end")), ["path", "end"], "left_anti")
    return malformed.unionByName(twice).unionByName(nothing).unionByName(free.select("path", F.lit("no_type").alias("code"), F.col("part").alias("detail")))


def package_problems(package_parts: DataFrame) -> DataFrame:
    """``path, code, detail`` of everything that is wrong with packages; all faults, not the first.

    Names of styles and numbers only are shown, never text of a document.
    """
    from ..sources import definitions, packages, writing

    sound = package_parts.where("fault IS NULL")
    styles, numbers = definitions.styles(sound), definitions.numbering(sound)
    rows = packages.paragraphs(sound)
    nums = numbers.where("kind = 'num'")

    def lacking(refs: DataFrame, name: str, have: DataFrame, code: str) -> DataFrame:
        told = refs.select("path", F.col(name).alias("detail")).where("detail IS NOT NULL").distinct()
        return told.join(have, ["path", "detail"], "left_anti").select("path", F.lit(code).alias("code"), "detail")

    ids = styles.select("path", F.col("style_id").alias("detail"))
    known = nums.select("path", F.col("owner").alias("detail")).union(nums.select("path", F.lit("0")))
    found = [
        package_parts.where("fault IS NOT NULL").select("path", F.lit("package").alias("code"), F.col("fault").alias("detail")),
        lacking(rows, "style", ids, "style_of_paragraph"), lacking(styles, "based_on", ids, "style_based_on"),
        lacking(rows.where("num_id <> '0'"), "num_id", known, "number_of_paragraph"), lacking(styles.where("num_id <> '0'"), "num_id", known, "number_of_style"),
        lacking(nums, "abstract_id", numbers.where("kind = 'level'").select("path", F.col("owner").alias("detail")), "levels_of_number"),
        writing.ill_formed(sound).select("path", F.lit("ill_formed").alias("code"), F.col("part").alias("detail")),
        writing.dangling(definitions.relationships(sound), sound).select("path", F.lit("relationship").alias("code"), F.concat_ws("#", "part", "rel_id").alias("detail")),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out
