"""Headers and footers of a template put into other packages, and the numbers and titles in them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup, ordering, textnodes
from ..session import cut
from ..sources import definitions, scanning

# Names that the package format prescribes, and what may follow a title page among section properties.
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_CONTENT = "application/vnd.openxmlformats-officedocument.wordprocessingml.{}+xml"
IMAGES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "emf": "image/x-emf", "wmf": "image/x-wmf", "svg": "image/svg+xml"}
BEHIND_TITLE = ordering.SECTION_ORDER[ordering.SECTION_ORDER.index("titlePg") + 1 :]

_NUMBERING = "word/numbering.xml"
_TYPES, _RELS, _MAIN = "[Content_Types].xml", "word/_rels/document.xml.rels", "word/document.xml"


def shown_parts(package_parts: DataFrame, relationships: DataFrame | None = None) -> DataFrame:
    """``path, rel_id, kind, part``: the header and footer parts that main parts relate to; relationships tell, not names."""
    rels = (relationships or definitions.relationships(package_parts)).where(F.col("part") == _RELS)
    kind = F.regexp_extract("type", "/(header|footer)$", 1)
    return rels.where((kind != "") & F.col("resolved").isNotNull()).select("path", "rel_id", kind.alias("kind"), F.col("resolved").alias("part"))


def _rels_of(part: Column) -> Column:
    return F.regexp_replace(part, "([^/]+)$", "_rels/$1.rels")


def _digest(content: Column) -> Column:
    return F.left(F.sha2(content, 256), F.lit(12))


def import_problems(template_parts: DataFrame) -> DataFrame:
    """``path, code, detail``: what forbids a template's headers and footers: ``both_kinds``, ``not_an_image`` (an inner relationship), ``missing``."""
    own = shown_parts(template_parts)
    kinds = own.groupBy("path", "part").agg(F.countDistinct("kind").alias("n")).where("n > 1").select("path", F.lit("both_kinds").alias("code"), F.col("part").alias("detail"))
    lost = own.join(template_parts.select("path", "part"), ["path", "part"], "left_anti").select("path", F.lit("missing").alias("code"), F.col("part").alias("detail"))
    homes = own.select("path", _rels_of(F.col("part")).alias("part")).distinct()
    inner = definitions.relationships(template_parts).where("NOT external").join(homes, ["path", "part"])
    strange = inner.where(~F.col("type").endswith("/image")).select("path", F.lit("not_an_image").alias("code"), F.concat_ws("#", "part", "rel_id").alias("detail"))
    return kinds.unionByName(lost.distinct()).unionByName(strange)


def wiring(template_parts: DataFrame, relationships: DataFrame | None = None) -> DataFrame:
    """``template, kind, type, title_page, part, new_part, new_rel``: what the last section of each template shows.

    New names hold a digest of the content, so they can't meet a part of
    another content in a target.
    """
    shown = cut(shown_parts(template_parts, relationships))
    named = template_parts.join(shown.select("path", "part").distinct(), ["path", "part"], "left_semi").select("path", "part", _digest(F.col("content")).alias("digest"))
    last = definitions.sections(template_parts).groupBy("path").agg(F.max_by(F.struct("section_index", "title_page"), "section_index").alias("s")).select("path", "s.*")
    refs = definitions.header_footer_refs(template_parts).join(last, ["path", "section_index"]).where("rel_id IS NOT NULL")
    full = refs.join(shown.drop("kind"), ["path", "rel_id"]).join(named, ["path", "part"])
    stem = F.concat_ws("_", "kind", "digest")
    return full.select(F.col("path").alias("template"), "kind", "type", "title_page", "part", F.concat(F.lit("word/"), stem, F.lit(".xml")).alias("new_part"), F.concat(F.lit("rId_"), stem).alias("new_rel"))


def _retargeted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        made = []
        for text, targets in zip(b["text"], b["targets"]):
            to = {t["rel_id"]: t["target"] for t in targets}

            def one(m: re.Match) -> str:
                own = re.search(r'\bId="([^"]*)"', m[0])
                return re.sub(r'\bTarget="[^"]*"', f'Target="{to[own[1]]}"', m[0]) if own and own[1] in to else m[0]

            made.append(re.sub(r"<Relationship\b[^>]*>", one, text))
        yield b[["template", "part"]].assign(text=made)


def _section(xml: str, refs: str, title: bool) -> str:
    """Section properties that show ``refs`` and nothing else."""
    head, inner = re.match(r"(<w:sectPr\b[^>]*?)(?:/>$|>(.*)</w:sectPr>$)", xml, re.S).groups()
    inner = re.sub(r"<w:(?:headerReference|footerReference|titlePg)\b[^>]*/>", "", inner or "")
    at = min((m.start() for m in re.finditer(rf"<w:(?:{'|'.join(BEHIND_TITLE)})\b", inner)), default=len(inner))
    return f"{head}>{refs}{inner[:at]}{'<w:titlePg/>' if title else ''}{inner[at:]}</w:sectPr>"


def _wired(part: str, text: str, wires: list, images: list, gone: list) -> str:
    if part == _RELS:
        kept = re.sub(r'<Relationship\b(?=[^>]*\bType="[^"]*/(?:header|footer)")[^>]*?(?:/>|>\s*</Relationship>)', "", text)
        new = {w["new_rel"]: f'<Relationship Id="{w["new_rel"]}" Type="{_OFFICE}/{w["kind"]}" Target="{w["new_part"].removeprefix("word/")}"/>' for w in wires}
        return kept.replace("</Relationships>", "".join(new.values()) + "</Relationships>")
    if part == _TYPES:
        for name in gone:
            text = re.sub(rf'<Override\b(?=[^>]*\bPartName="/{re.escape(name)}")[^>]*/>', "", text)
        said = {e.lower() for e in re.findall(r'<Default\b[^>]*\bExtension="([^"]*)"', text)}
        more = [f'<Default Extension="{e}" ContentType="{IMAGES.get(e, "application/octet-stream")}"/>' for e in sorted(set(images)) if e not in said]
        more += sorted({f'<Override PartName="/{w["new_part"]}" ContentType="{_CONTENT.format(w["kind"])}"/>' for w in wires})
        return text.replace("</Types>", "".join(more) + "</Types>")
    refs = "".join(f'<w:{w["kind"]}Reference xmlns:r="{_OFFICE}" w:type="{w["type"]}" r:id="{w["new_rel"]}"/>' for w in wires)
    title = any(w["title_page"] for w in wires)
    spans = [(a, b) for a, b, _ in scanning.spans(text, "w:sectPr")]
    if not spans:
        return text.replace("</w:body>", _section("<w:sectPr/>", refs, title) + "</w:body>")
    out, last = [], 0
    for a, b in spans:
        out += [text[last:a], _section(text[a:b], refs, title)]
        last = b
    return "".join([*out, text[last:]])


def _rewired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        made = [_wired(p, t, list(w), list(i), list(g)) for p, t, w, i, g in zip(b["part"], b["text"], b["wires"], b["images"], b["gone"])]
        yield b[["path", "part"]].assign(text=made)


def imported(target_parts: DataFrame, template_parts: DataFrame, assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replacements and exclusions for ``writing.patched``: each target shows its template's headers and footers in all sections.

    ``assigned``: ``path, template``, a template a target.  A target whose
    template shows none stays as it is.  The target's own header and footer
    parts leave; pictures come along under names of their content; links to
    the outside stay as they are.
    """
    # What is small is read once; contents join what was worked out from it at the end.
    own_rels = cut(definitions.relationships(template_parts))
    wires = cut(wiring(template_parts, own_rels))
    used = cut(assigned.join(wires.select("template").distinct(), "template", "left_semi"))
    contents = template_parts.select(F.col("path").alias("template"), "part", "content")
    heads = wires.select("template", "part", "new_part").distinct()
    rels = own_rels.where("NOT external AND resolved IS NOT NULL").withColumnRenamed("path", "template")
    rels = rels.join(heads.select("template", _rels_of(F.col("part")).alias("part"), _rels_of(F.col("new_part")).alias("new_part")), ["template", "part"])
    extension = F.lower(F.regexp_extract("resolved", r"[.]([^./]+)$", 1))
    pictures = rels.join(contents.select("template", F.col("part").alias("resolved"), _digest(F.col("content")).alias("digest")), ["template", "resolved"])
    media = cut(pictures.select("template", "resolved", "part", "new_part", "rel_id", extension.alias("extension"), F.concat(F.lit("media/"), "digest", F.lit("."), extension).alias("target")))
    targets = media.groupBy("template", "part").agg(F.collect_list(F.struct("rel_id", "target")).alias("targets"))
    homes = heads.select("template", _rels_of(F.col("part")).alias("part"), _rels_of(F.col("new_part")).alias("new_part"))
    texts = contents.join(homes, ["template", "part"]).join(targets, ["template", "part"], "left")
    empty = F.array().cast("array<struct<rel_id:string,target:string>>")
    made = texts.select("template", F.col("new_part").alias("part"), markup.decoded(F.col("content")).alias("text"), F.coalesce("targets", empty).alias("targets")).mapInPandas(_retargeted, "template string, part string, text string")
    renamed = heads.unionByName(media.select("template", F.col("resolved").alias("part"), F.concat(F.lit("word/"), "target").alias("new_part")).distinct())
    new = contents.join(renamed, ["template", "part"]).select("template", F.col("new_part").alias("part"), "content").unionByName(made.select("template", "part", markup.encoded(F.col("text")).alias("content")))
    gone = cut(shown_parts(target_parts).join(used, "path", "left_semi").select("path", "part").distinct())
    per = wires.groupBy("template").agg(F.array_sort(F.collect_set(F.struct("kind", "type", "title_page", "new_part", "new_rel"))).alias("wires"))
    images = media.groupBy("template").agg(F.collect_set("extension").alias("images"))
    names = gone.groupBy("path").agg(F.collect_set("part").alias("gone"))
    none = F.array().cast("array<string>")
    plan = cut(used.join(per, "template").join(images, "template", "left").join(names, "path", "left").select("path", "wires", F.coalesce("images", none).alias("images"), F.coalesce("gone", none).alias("gone")))
    files = target_parts.where(F.col("part").isin(_TYPES, _RELS, _MAIN)).join(plan, "path").select("path", "part", markup.decoded(F.col("content")).alias("text"), "wires", "images", "gone")
    rewired = files.mapInPandas(_rewired, "path string, part string, text string").select("path", "part", markup.encoded(F.col("text")).alias("content"))
    replacements = cut(rewired.unionByName(used.join(new, "template").select("path", "part", "content").dropDuplicates(["path", "part"])))
    leave = gone.unionByName(gone.select("path", _rels_of(F.col("part")).alias("part")))
    return replacements, leave.join(replacements.select("path", "part"), ["path", "part"], "left_anti")


def _like(form: str, new: str) -> str:
    """``new`` in the case of ``form``: all capitals, or words with capitals where it is all capitals itself."""
    if form.upper() == form:
        return new.upper()
    return " ".join(w[:1].upper() + w[1:].lower() for w in new.split(" ")) if new.upper() == new else new


def _digits(old: str, new: str) -> str | None:
    """The digits of ``new`` in the places of the digits of ``old``; None where they are not as many."""
    left = iter(re.sub(r"\D", "", new))
    if len(re.sub(r"\D", "", old)) != len(re.sub(r"\D", "", new)):
        return None
    return re.sub(r"\d", lambda _: next(left), old)


def _first(xml: str, forms: list[tuple[str, str | None]]) -> str:
    """``xml`` with the first of ``forms`` that stands in its text as whole words replaced once."""
    text = "".join(t for _, t, _ in textnodes.nodes(xml))
    for old, new in forms:
        found = re.search(rf"(?<!\w){re.escape(old)}(?!\w)", text) if old and new else None
        if found:
            return textnodes.replaced(xml, *found.span(), new)
    return xml


def _retold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        made = []
        for r in b.itertuples(index=False):
            number, title = r.old_number or "", r.old_title or ""
            spelled = " ".join(w[:1].upper() + w[1:].lower() for w in title.split(" "))
            titles = [(t, _like(t, r.new_title or "")) for t in (spelled, title.upper(), title)]
            compact = re.sub(r"\s", "", number)
            numbers = [(n, _digits(n, r.new_number or "")) for n in (number, compact)]
            out, last = [], 0
            for a, z, _ in scanning.spans(r.text):
                out += [r.text[last:a], _first(_first(r.text[a:z], titles), numbers)]
                last = z
            made.append("".join([*out, r.text[last:]]))
        yield b[["path", "part"]].assign(text=made, changed=[m != t for m, t in zip(made, b["text"])])


def tokens_replaced(package_parts: DataFrame, tokens: DataFrame) -> DataFrame:
    """``path, part, content`` of header and footer parts in which a section's number or title was replaced.

    ``tokens``: ``path, old_number, new_number, old_title, new_title``; null
    and empty ones replace nothing.  In each paragraph the first whole-word
    title counts (words with capitals, all capitals, as given, in that order)
    and the first number, spaced as given or without spaces; the new one takes
    the old one's case and separators, across runs.  A number of another count
    of digits is not put in.  Text boxes and drawings are left alone.
    """
    shown = shown_parts(package_parts).select("path", "part").distinct()
    rows = package_parts.join(shown, ["path", "part"], "left_semi").join(tokens, "path")
    rows = rows.select("path", "part", markup.decoded(F.col("content")).alias("text"), "old_number", "new_number", "old_title", "new_title")
    made = rows.mapInPandas(_retold, "path string, part string, text string, changed boolean").where("changed")
    return made.select("path", "part", markup.encoded(F.col("text")).alias("content"))


def _lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, text in zip(b["path"], b["text"]):
            for tag, own in (("w:abstractNum", "abstractNumId"), ("w:num", "numId")):
                for a, z, _ in scanning.spans(text, tag):
                    xml = text[a:z]
                    link = re.search(r'<w:abstractNumId\b[^>]*w:val="(\d+)"', xml)
                    rows.append((path, tag[2:], int(re.search(rf'w:{own}="(\d+)"', xml)[1]), int(link[1]) if link and tag == "w:num" else None, xml))
        yield pd.DataFrame(rows, columns=["path", "kind", "id", "abstract_id", "xml"]).astype({"abstract_id": "Int64"})


def list_blocks(package_parts: DataFrame) -> DataFrame:
    """``path, kind, id, abstract_id, xml``: the definitions (``abstractNum``) and instances (``num``) of lists."""
    texts = package_parts.where("part = 'word/numbering.xml'").select("path", markup.decoded(F.col("content")).alias("text"))
    return texts.mapInPandas(_lists, "path string, kind string, id long, abstract_id long, xml string")


def _numbering_wired(target_parts: DataFrame, without: DataFrame) -> DataFrame:
    """``path, part, content`` of the content types and relationships of ``without`` (path), with a numbering part among them."""
    declared = f'<Override PartName="/{_NUMBERING}" ContentType="{_CONTENT.format("numbering")}"/></Types>'
    related = f'<Relationship Id="rId_numbering" Type="{_OFFICE}/numbering" Target="numbering.xml"/></Relationships>'
    empty = {_TYPES: '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"></Types>', _RELS: '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"></Relationships>'}
    wanted = without.select("path", F.explode(F.array(F.lit(_TYPES), F.lit(_RELS))).alias("part"))
    texts = wanted.join(target_parts.select("path", "part", markup.decoded(F.col("content")).alias("text")), ["path", "part"], "left")
    text = F.coalesce("text", F.when(F.col("part") == _TYPES, empty[_TYPES]).otherwise(empty[_RELS]))
    opened = F.regexp_replace(text, r"(<(Types|Relationships)\b[^>]*)/>\s*$", "$1></$2>")
    full = F.when(F.col("part") == _TYPES, F.replace(opened, F.lit("</Types>"), F.lit(declared))).otherwise(F.replace(opened, F.lit("</Relationships>"), F.lit(related)))
    return texts.select("path", "part", markup.encoded(full).alias("content"))


def imported_lists(target_parts: DataFrame, template_parts: DataFrame, needed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``path, template, num_id, new_id`` and the numbering parts (``path, part, content``) that hold the lists under new ids.

    ``needed``: ``path, template, num_id``.  New ids follow the target's
    highest, in the order of the old ones; definitions come once a target and
    template, under an id and mark (nsid) of their own.  A list that the
    template lacks is left out.  A target without a numbering part gets one,
    and with it the rows that declare and relate it.
    """
    have, own = list_blocks(target_parts), list_blocks(template_parts).withColumnRenamed("path", "template")
    top = have.groupBy("path").pivot("kind", ["abstractNum", "num"]).agg(F.max("id"))
    nums = needed.distinct().join(own.where("kind = 'num'").select("template", F.col("id").cast("string").alias("num_id"), "id", "abstract_id", "xml"), ["template", "num_id"])
    defs = nums.select("path", "template", "abstract_id").distinct().join(own.where("kind = 'abstractNum'").select("template", F.col("id").alias("abstract_id"), "xml"), ["template", "abstract_id"])

    def fresh(rows: DataFrame, kind: str, old: str, least: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("path").orderBy("template", old))  # a row a list of one package
        return rows.join(top.select("path", F.col(kind).alias("top")), "path", "left").withColumn("new_id", F.coalesce("top", F.lit(least)) + place).drop("top")

    defs = fresh(defs, "abstractNum", "abstract_id", -1)
    nums = fresh(nums, "num", "id", 0).join(defs.select("path", "template", "abstract_id", F.col("new_id").alias("new_def")), ["path", "template", "abstract_id"])
    text = lambda x: F.col(x).cast("string")
    mark = F.upper(F.left(F.sha1(F.concat_ws("#", markup.canonical(F.col("xml")), "template", text("new_id"))), F.lit(8)))
    def_xml = F.regexp_replace(F.regexp_replace("xml", F.lit(r'(<w:abstractNum\b[^>]*w:abstractNumId=")[^"]*'), F.concat(F.lit("$1"), text("new_id"))), F.lit(r'(<w:nsid w:val=")[^"]*'), F.concat(F.lit("$1"), mark))
    num_xml = F.regexp_replace(F.regexp_replace("xml", F.lit(r'(<w:num\b[^>]*w:numId=")[^"]*'), F.concat(F.lit("$1"), text("new_id"))), F.lit(r'(<w:abstractNumId\b[^>]*w:val=")[^"]*'), F.concat(F.lit("$1"), text("new_def")))

    def joined(rows: DataFrame, xml: Column, name: str) -> DataFrame:
        return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("new_id", xml.alias("xml")))), lambda s: s["xml"]), "").alias(name))

    files = target_parts.where(F.col("part") == _NUMBERING).select("path", "part", markup.decoded(F.col("content")).alias("text"))
    without = cut(nums.select("path").distinct().join(files.select("path"), "path", "left_anti"))
    files = files.unionByName(without.select("path", F.lit(_NUMBERING).alias("part"), F.lit('<w:numbering xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"></w:numbering>').alias("text")))
    files = files.join(joined(defs, def_xml, "defs"), "path").join(joined(nums, num_xml, "nums"), "path")
    # Definitions stand before all instances, instances before what ends the part.
    end = F.regexp_instr("text", F.lit("<w:numIdMacAtCleanup|</w:numbering>"))
    begin = F.regexp_instr("text", F.lit(r"<w:num\s|<w:numIdMacAtCleanup|</w:numbering>"))
    whole = F.concat(F.substr("text", F.lit(1), begin - 1), "defs", F.substr("text", begin, end - begin), "nums", F.substr("text", end))
    return nums.select("path", "template", "num_id", F.col("new_id").cast("string").alias("new_id")), files.select("path", "part", markup.encoded(whole).alias("content")).unionByName(_numbering_wired(target_parts, without))
