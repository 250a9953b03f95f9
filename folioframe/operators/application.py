"""A template's styles and numbering put on a folder of packages in one run, under a policy.

Every package has an outcome of its own: one with any fault leaves the run
whole and unchanged, the others go on.  What the run changed is proven by the
evidence of before and after.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..session import cut
from ..sources import definitions, packages, scanning, writing
from . import conversion, graph, invariants, registry, restyle, shells

#: Codes of a conversion plan that are no fault: there was nothing to convert.
NOTHING_TO_DO = ("unnumbered",)


class Run(NamedTuple):
    """``parts``: ``path, part, content, origin`` of every readable package; ``outcomes``: ``path, status``; ``faults``: ``path, code, detail``."""

    parts: DataFrame
    outcomes: DataFrame
    faults: DataFrame


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, text in zip(b["path"], b["text"]):
            for a, z, _ in scanning.spans(text, "w:style"):
                own = re.search(r'\bw:styleId="([^"]*)"', text[a:z])
                if own:
                    rows.append((path, own[1], text[a:z]))
        yield pd.DataFrame(rows, columns=["path", "style_id", "xml"])


def style_blocks(package_parts: DataFrame) -> DataFrame:
    """``path, style_id, xml`` of every style definition, as it stands in the style sheet."""
    texts = package_parts.where("part = 'word/styles.xml'").select("path", markup.decoded(F.col("content")).alias("text"))
    return texts.mapInPandas(_blocks, "path string, style_id string, xml string")


def _renamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ids and references of the imported styles by their new names, lists by their new numbers (or none)."""
    for b in batches:
        made = []
        for xml, names, lists, keep in zip(b["xml"], b["names"], b["lists"], b["numbers"]):
            new = {n["style_id"]: n["new_id"] for n in names}
            num = {n["num_id"]: n["new_id"] for n in lists}
            xml = re.sub(r'(<w:style\b[^>]*?\bw:styleId=")([^"]*)', lambda m: m[1] + new.get(m[2], m[2]), xml, count=1)
            xml = re.sub(r'(<w:(?:basedOn|link|next)\b[^>]*?\bw:val=")([^"]*)', lambda m: m[1] + new.get(m[2], m[2]), xml)
            # An imported default would change paragraphs that name no style.
            xml = re.sub(r'(<w:style\b[^>]*?)\s+w:default="[^"]*"', r"\1", xml, count=1)
            if keep:
                xml = re.sub(r'(<w:numId\b[^>]*?\bw:val=")([^"]*)', lambda m: m[1] + num.get(m[2], m[2]), xml)
            else:
                xml = re.sub(r"(?s)<w:numPr\b(?:[^>]*/>|[^>]*>.*?</w:numPr>)", "", xml)
            made.append(xml)
        yield b[["path", "style_id"]].assign(xml=made)


def imported_styles(targets: DataFrame, known: DataFrame, template_blocks: DataFrame, needed: DataFrame, new_lists: DataFrame, numbers: bool) -> tuple[DataFrame, DataFrame]:
    """``path, style_id, new_id`` and the blocks (``path, style_id, xml``) that the targets lack.

    ``targets``: ``path``; ``known``: the targets' ``style_blocks``;
    ``template_blocks``: those of one template; ``needed``: ``style_id``, a
    closure.  A style that a target has in the same words is used as it is; one
    of the same name and other words comes under a name with a digest of its
    own.  References among the imported styles follow the names, numbers the
    lists (``path, num_id, new_id``) where ``numbers``, else they are left out.
    """
    wanted = template_blocks.join(needed.select("style_id").distinct(), "style_id").select("style_id", "xml", markup.canonical(F.col("xml")).alias("words"))
    pairs = targets.select("path").join(wanted, F.lit(True)).join(known.select("path", "style_id", markup.canonical(F.col("xml")).alias("own")), ["path", "style_id"], "left")
    renamed = F.concat(F.col("style_id"), F.lit("__"), F.left(F.sha2("words", 256), F.lit(10)))
    named = cut(pairs.select("path", "style_id", "xml", F.when(F.col("own").isNull() | (F.col("own") == F.col("words")), F.col("style_id")).otherwise(renamed).alias("new_id"), F.col("own").eqNullSafe(F.col("words")).alias("there")))
    names = named.groupBy("path").agg(F.collect_list(F.struct("style_id", "new_id")).alias("names"))
    lists = new_lists.groupBy("path").agg(F.collect_list(F.struct("num_id", "new_id")).alias("lists"))
    none = F.array().cast("array<struct<num_id:string,new_id:string>>")
    rows = named.where("NOT there").join(names, "path").join(lists, "path", "left").select("path", F.col("new_id").alias("style_id"), "xml", "names", F.coalesce("lists", none).alias("lists"), F.lit(numbers).alias("numbers"))
    return named.select("path", "style_id", "new_id"), rows.mapInPandas(_renamed, "path string, style_id string, xml string")


def _supplied(template_parts: DataFrame, styles: DataFrame) -> DataFrame:
    """``style_id, supplied_paragraph, supplied_run``: names of the properties that a style states itself or inherits."""
    line = graph.closure(styles.select("style_id", "based_on").dropDuplicates(["style_id"]), "style_id", "based_on")
    stated = definitions.style_properties(template_parts).select(F.col("style_id").alias("node"), "kind", "property")
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("property")))
    return line.join(stated, "node").groupBy("style_id").agg(of("pPr").alias("supplied_paragraph"), of("rPr").alias("supplied_run"))


def _numbered_already(package_parts: DataFrame) -> DataFrame:
    """``path, paragraph_index`` of the paragraphs that a list numbers, by themselves or by their style's line."""
    styles = cut(definitions.styles(package_parts))
    key = lambda c: F.concat_ws("\n", "path", c)
    up = graph.inherit(styles.select(key("style_id").alias("key"), F.when(F.col("based_on").isNotNull(), key("based_on")).alias("up"), "num_id", "level").dropDuplicates(["key"]), "key", "up", ["num_id", "level"])
    of_style = up.select(F.split_part("key", F.lit("\n"), F.lit(1)).alias("path"), F.split_part("key", F.lit("\n"), F.lit(2)).alias("style_id"), "num_id", "level")
    told = definitions.effective_numbering(packages.paragraphs(package_parts), of_style, definitions.numbering(package_parts))
    return told.where("num_id IS NOT NULL").select("path", "paragraph_index")


def _told(frame: DataFrame, code, detail) -> DataFrame:
    return frame.select("path", (F.lit(code) if isinstance(code, str) else code).alias("code"), detail.cast("string").alias("detail"))


def run(package_parts: DataFrame, template_parts: DataFrame, entries: DataFrame, roles: DataFrame, mode: str) -> Run:
    """All packages of ``package_parts`` (``packages.parts``, faulty ones too) under the policy ``mode``.

    ``template_parts``: the parts of one template; ``entries``:
    ``registry.entries`` of it (style_id, num_id, level of each role);
    ``roles``: ``path, paragraph_index, role``, the paragraphs to be styled.

    ``format_only`` keeps numbering as it is: imported styles bring none and
    paragraphs keep theirs.  ``convert`` brings the template's lists over and
    turns typed numbers into automatic ones.  Faults, all of which are rows:
    ``package`` (unreadable), ``no_paragraphs`` (no role is given), ``role_unknown``,
    ``role_unnumbered`` (convert only), a conversion plan's codes, ``drift:``
    and a code, ``changed:`` and a kind of evidence, ``problem:`` and a code
    that the package didn't have before.  A package with any of these keeps its
    parts (``origin`` is ``kept`` for all), an unreadable one has none.
    """
    policy = restyle.POLICIES[mode]
    # Every reader below goes over the parts; packages are opened once.
    package_parts, template_parts = cut(package_parts.select("path", "part", "content", "fault")), cut(template_parts.select("path", "part", "content", "fault"))
    broken = package_parts.where("fault IS NOT NULL").select("path", F.lit("package").alias("code"), F.col("fault").alias("detail"))
    sound = package_parts.where("fault IS NULL")
    paths = cut(sound.select("path").distinct())
    of_role = cut(entries.select("role", F.col("style_id").alias("role_style"), "num_id", "level"))
    wanted = cut(roles.join(paths, "path").join(of_role, "role", "left"))
    faults = [broken, _told(paths.join(wanted, "path", "left_anti"), "no_paragraphs", F.lit(None)), _told(wanted.where("role_style IS NULL"), "role_unknown", F.col("role")).distinct()]

    marked = cut(scanning.paragraph_markup(sound))
    given = wanted.where("role_style IS NOT NULL")
    if policy["import_numbering"]:
        faults.append(_told(given.where("num_id IS NULL"), "role_unnumbered", F.col("role")).distinct())
        template = template_parts.select(F.col("path").alias("template")).distinct()
        needed_lists = paths.join(template, F.lit(True)).join(of_role.select("num_id").where("num_id IS NOT NULL").distinct(), F.lit(True)).select("path", "template", "num_id")
        new_lists, list_parts = shells.imported_lists(sound, template_parts, needed_lists)
        new_lists, list_parts = cut(new_lists.select("path", "num_id", "new_id")), cut(list_parts)
    else:
        new_lists, list_parts = paths.limit(0).selectExpr("path", "'' AS num_id", "'' AS new_id"), None

    template_styles = cut(definitions.styles(template_parts))
    needed = restyle.closure(template_styles, template_parts.select("path").distinct().join(of_role.select(F.col("role_style").alias("style_id")).distinct(), F.lit(True)))
    names, blocks = imported_styles(paths, style_blocks(sound), style_blocks(template_parts), needed, new_lists, not policy["preserve_numbering"])
    sheets = cut(registry.inserted_styles(sound, definitions.styles(sound), blocks))

    body, converted = marked, None
    if policy["convert"]:
        automatic = _numbered_already(sound).withColumn("automatic", F.lit(True))
        numbered = given.where("num_id IS NOT NULL").join(new_lists, ["path", "num_id"]).join(automatic, ["path", "paragraph_index"], "left")
        numbered = numbered.select("path", "paragraph_index", "role", "automatic", F.col("new_id").alias("num_id"), "level")
        plan = cut(conversion.planned(marked, numbered))
        converted = cut(conversion.edits(plan))
        refused = plan.select("path", "paragraph_index", "code").unionByName(converted.select("path", "paragraph_index", "code")).where(F.col("code").isNotNull() & ~F.col("code").isin(*NOTHING_TO_DO))
        faults += [_told(refused, F.col("code"), F.col("paragraph_index")), _told(conversion.drift(plan, converted), F.concat(F.lit("drift:"), "code"), F.col("paragraph_index"))]
        new_xml = converted.where("code IS NULL").select("path", "paragraph_index", F.col("xml").alias("new_xml"))
        body = marked.join(new_xml, ["path", "paragraph_index"], "left").withColumn("xml", F.coalesce("new_xml", "xml")).drop("new_xml")
    assigned = given.join(names.withColumnRenamed("style_id", "role_style"), ["path", "role_style"]).join(_supplied(template_parts, template_styles).withColumnRenamed("style_id", "role_style"), "role_style", "left")
    assigned = cut(assigned.select("path", "paragraph_index", F.col("new_id").alias("new_style"), "supplied_paragraph", "supplied_run"))
    edits = cut(restyle.edits(body, assigned))
    if converted is not None:
        # Paragraphs that were converted but may not be restyled keep the conversion.
        rest = converted.where("code IS NULL").select(*edits.columns).join(edits.select("path", "paragraph_index"), ["path", "paragraph_index"], "left_anti")
        edits = edits.unionByName(rest.select(*edits.columns))

    replaced = restyle.spliced(sound, edits).unionByName(sheets)
    after = cut(writing.patched(sound, replaced if list_parts is None else replaced.unionByName(list_parts)))
    made = after.withColumn("fault", F.lit(None).cast("string"))
    told_after = cut(scanning.paragraph_markup(made))
    expected = body if converted is not None else marked
    faults += [_told(restyle.drift(expected, told_after, assigned), F.concat(F.lit("drift:"), "code"), F.col("paragraph_index"))]
    # Lists may be gained where they are imported, runs lose what a style supplies (which ``drift`` proves); nothing else may change.
    moved = invariants.violations(cut(invariants.evidence(sound)), cut(invariants.evidence(made)), kinds=tuple(k for k in invariants.KINDS if k != "runs"))
    allowed = (F.col("kind") == "list") & (F.col("change") == "gained") & F.lit(policy["import_numbering"])
    faults.append(_told(moved.where(~allowed), F.concat(F.lit("changed:"), "kind"), F.col("owner")).distinct())
    fresh = restyle.package_problems(made).join(restyle.package_problems(sound), ["path", "code", "detail"], "left_anti")
    faults.append(_told(fresh, F.concat(F.lit("problem:"), "code"), F.col("detail")))

    found = cut(reduce(DataFrame.unionByName, faults))
    failed = found.select("path").distinct()
    kept = sound.join(failed, "path", "left_semi").select("path", "part", "content", F.lit("kept").alias("origin"))
    everyone = package_parts.select("path").distinct().join(failed.withColumn("failed", F.lit(True)), "path", "left")
    outcomes = everyone.select("path", F.when(F.col("failed"), "failed").otherwise("succeeded").alias("status"))
    return Run(after.join(failed, "path", "left_anti").unionByName(kept), outcomes, found)
