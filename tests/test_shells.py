"""Conversion, headers, lists and styles of packages, from file to file."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioframe.operators import conversion, registry, restyle, shells
from folioframe.sources import definitions, packages, scanning, writing

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _rels(*rows):
    inner = "".join(f'<Relationship Id="{i}" Type="{OFFICE}/{t}" Target="{g}"/>' for i, t, g in rows)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'


def _package(folder, name, body, more):
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/old.xml" ContentType="x"/></Types>',
        "_rels/.rels": _rels(), "word/styles.xml": f'<w:styles {W}><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="H1"/></w:style></w:styles>', "word/document.xml": f"<w:document {W} {R}><w:body>{body}</w:body></w:document>",
    } | more
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for part, content in parts.items():
            z.writestr(part, content)
    (folder / name).write_bytes(out.getvalue())


def _run(text, more=""):
    return f'<w:r>{more}<w:t xml:space="preserve">{text}</w:t></w:r>'


def _lists(first_def, first_num, mark):
    level = '<w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1"/></w:lvl>'
    return f'<w:numbering {W}><w:abstractNum w:abstractNumId="{first_def}"><w:nsid w:val="{mark}"/>{level}</w:abstractNum><w:num w:numId="{first_num}"><w:abstractNumId w:val="{first_def}"/></w:num></w:numbering>'


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("packages")
    header = f'<w:hdr {W} {R}><w:p>{_run("SECTION 01 ")}{_run("10 00 - SUMMARY")}{_run(" OF WORK")}</w:p><w:p>{_run("Summary Of Work 011000")}</w:p><w:p>{_run("9011000 SUMMARYOF WORK")}</w:p></w:hdr>'
    _package(folder, "template.docx", f'<w:p><w:pPr><w:jc w:val="center"/></w:pPr>{_run("1.01 x", "<w:rPr><w:b/></w:rPr>")}</w:p><w:sectPr><w:headerReference w:type="default" r:id="h"/><w:footerReference w:type="first" r:id="f"/><w:titlePg/></w:sectPr>', {
        "word/_rels/document.xml.rels": _rels(("h", "header", "header7.xml"), ("f", "footer", "footer7.xml"), ("s", "styles", "styles.xml")), "word/header7.xml": header, "word/footer7.xml": f"<w:ftr {W}><w:p/></w:ftr>",
        "word/_rels/header7.xml.rels": _rels(("i", "image", "media/a.PNG")), "word/media/a.PNG": b"picture", "word/numbering.xml": _lists(3, 5, "AAAA0000"),
    })
    body = (
        f'<w:p>{_run("PART ")}{_run("1")}<w:r><w:tab/></w:r>{_run("GENERAL")}</w:p><w:p><w:pPr><w:pStyle w:val="H1"/><w:jc w:val="left"/></w:pPr>{_run(" A")}{_run(".  ")}{_run("Sco&amp;pe")}</w:p>'
        f'<w:p>{_run("1.")}<w:r><w:br/></w:r>{_run("broken")}</w:p><w:p>{_run("B. other")}</w:p><w:p>{_run("plain")}</w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr>{_run("auto")}</w:p>'
        f'<w:p><w:ins>{_run("A. tracked")}</w:ins></w:p><w:sectPr><w:headerReference w:type="even" r:id="o"/><w:pgSz w:w="1"/><w:docGrid/></w:sectPr>'
    )
    _package(folder, "target.docx", body, {"word/_rels/document.xml.rels": _rels(("o", "header", "old.xml"), ("s", "styles", "styles.xml")), "word/old.xml": f"<w:hdr {W}/>", "word/numbering.xml": _lists(0, 1, "BBBB0000")})
    parts = packages.parts(packages.files(spark, str(folder))).cache()
    assert parts.where("fault IS NOT NULL").isEmpty()
    return {k: parts.where(F.col("path").endswith(f"{k}.docx")).cache() for k in ("template", "target")}


def _path(parts):
    return parts.first().path


def _again(parts):
    return parts.withColumn("fault", F.lit(None).cast("string"))


def test_typed_numbers_become_automatic(spark, found):
    target, path = found["target"], _path(found["target"])
    marked = scanning.paragraph_markup(target)
    roles = ["PART", "PARAGRAPH", "SUBPARAGRAPH", "SUBPARAGRAPH", "ARTICLE", "PARAGRAPH", "PARAGRAPH", "PARAGRAPH"]
    rows = [(path, i, r, i == 5, "9", str(i)) for i, r in enumerate(roles)]
    plan = conversion.planned(marked, spark.createDataFrame(rows, "path string, paragraph_index long, role string, automatic boolean, num_id string, level string")).cache()
    assert {r.paragraph_index: r.code for r in plan.collect()} == {0: None, 1: None, 2: None, 3: "other_marker", 4: "unnumbered", 5: None, 6: "tracked", 7: "out_of_range"}
    changed = conversion.edits(plan).cache()
    assert {r.paragraph_index: r.code for r in changed.collect()} == {0: None, 1: None, 2: "line_break", 5: None}
    assert conversion.drift(plan, changed).isEmpty()
    hurt = changed.withColumn("xml", F.when(F.col("paragraph_index") == 0, F.replace("xml", F.lit("GEN"), F.lit("GNE"))).otherwise(F.replace("xml", F.lit("<w:jc"), F.lit("<w:ind"))))
    assert {(r.paragraph_index, r.code) for r in conversion.drift(plan, hurt).collect()} == {(0, "text"), (1, "markup")}
    made = _again(writing.patched(target, restyle.spliced(target, changed.where("code IS NULL"))))
    got = packages.paragraphs(made).orderBy("paragraph_index").collect()
    assert [(r.text, r.num_id, r.level) for r in got[:3]] == [("GENERAL", "9", "0"), ("Sco&pe", "9", "1"), ("1.broken", None, None)] and (got[5].num_id, got[5].text) == ("9", "auto")


def test_headers_come_over(spark, found):
    target, template = found["target"], found["template"]
    assigned = spark.createDataFrame([(_path(target), _path(template))], "path string, template string")
    assert shells.import_problems(template).isEmpty()
    new, gone = shells.imported(target, template, assigned)
    made = _again(writing.patched(target, new, gone)).cache()
    assert writing.ill_formed(made).isEmpty()
    assert {r.type: r.kind for r in definitions.header_footer_refs(made).collect()} == {"default": "header", "first": "footer"}
    shown = shells.shown_parts(made).collect()
    assert sorted(r.kind for r in shown) == ["footer", "header"] and made.where("part = 'word/old.xml'").isEmpty()
    rels = definitions.relationships(made)
    assert writing.dangling(rels, made).isEmpty() and rels.where("type LIKE '%/image'").first().resolved.endswith(".png")
    with zipfile.ZipFile(io.BytesIO(writing.packed(made).first().package)) as z:
        types, main = z.read("[Content_Types].xml").decode(), z.read("word/document.xml").decode()
    assert "old.xml" not in types and 'Extension="png"' in types and types.count("<Override") == 2
    assert main.index("<w:pgSz") < main.index("<w:titlePg/>") < main.index("<w:docGrid/>") and "even" not in main
    tokens = spark.createDataFrame([(_path(target), "01 10 00", "22 33 44", "Summary of Work", "PIPES & PUMPS")], "path string, old_number string, new_number string, old_title string, new_title string")
    said = shells.tokens_replaced(made, tokens).collect()
    assert len(said) == 1
    texts = made.join(spark.createDataFrame([(r.path, r.part, r.content) for r in said], "path string, part string, new binary"), ["path", "part"])
    from folioframe.functions import textnodes

    lines = ["".join(t for _, t, _ in textnodes.nodes(x)) for x in bytes(texts.first().new).decode().split("</w:p>")]
    assert lines[:3] == ["SECTION 22 33 44 - PIPES & PUMPS", "Pipes & Pumps 223344", "9011000 SUMMARYOF WORK"]
    none = tokens.limit(0)
    assert shells.tokens_replaced(made, none).isEmpty()


def test_lists_come_over(spark, found):
    target, template = found["target"], found["template"]
    needed = spark.createDataFrame([(_path(target), _path(template), n) for n in ("5", "5", "77")], "path string, template string, num_id string")
    ids, files = shells.imported_lists(target, template, needed)
    assert [(r.num_id, r.new_id) for r in ids.collect()] == [("5", "2")]
    made = _again(writing.patched(target, files))
    assert writing.ill_formed(made).isEmpty()
    blocks = {(r.kind, r.id): (r.abstract_id, r.xml) for r in shells.list_blocks(made).collect()}
    assert set(blocks) == {("abstractNum", 0), ("abstractNum", 1), ("num", 1), ("num", 2)} and blocks["num", 2][0] == 1 and "AAAA0000" not in blocks["abstractNum", 1][1]
    text = bytes(files.first().content).decode()
    assert text.rindex("<w:abstractNum ") < text.index("<w:num ")


def test_registry_and_derived_styles(spark, found):
    template, path = found["template"], _path(found["template"])
    marked = scanning.paragraph_markup(template).where("NOT has_section")
    given = spark.createDataFrame([(path, "ARTICLE", 0, "Art"), (path, "PART", 9, "Part")], "path string, role string, paragraph_index long, style_id string")
    numbering = spark.createDataFrame([(path, "Part", "5", None)], "path string, style_id string, num_id string, level string")
    got = {r.role: (r.provenance, r.num_id, r.level) for r in registry.entries(given, scanning.paragraph_profile(marked), numbering).collect()}
    assert got == {"ARTICLE": ("text_literal", None, None), "PART": ("style_numpr", "5", "0")}
    wanted = spark.createDataFrame([(path, 0, "Art", 'A "&" B', "H1"), (path, 0, "H1", None, None)], "path string, paragraph_index long, style_id string, name string, base string")
    files = registry.inserted_styles(template, definitions.styles(template), registry.derived_styles(marked, wanted))
    made = _again(writing.patched(template, files))
    assert writing.ill_formed(made).isEmpty()
    assert {(r.style_id, r.name, r.based_on) for r in definitions.styles(made).collect()} == {("H1", "H1", None), ("Art", 'A "&" B', "H1")}
    assert {(r.kind, r.property, r.value) for r in definitions.style_properties(made).where("style_id = 'Art'").collect()} == {("pPr", "jc", "center"), ("rPr", "b", "true")}
