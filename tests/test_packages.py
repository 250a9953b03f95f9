import io
import zipfile

from folioframe.sources import definitions, packages, writing

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
STYLES = f"""<w:styles {W}><w:style w:type="paragraph" w:styleId="H1" w:default="1"><w:name w:val="heading"/><w:basedOn w:val="N"/><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="4"/></w:numPr></w:pPr></w:style>
<w:style w:type="character" w:styleId="C"/></w:styles>"""
NUMBERING = f"""<w:numbering {W}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl>
<w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="upperLetter"/><w:lvlText w:val="%2."/></w:lvl></w:abstractNum>
<w:num w:numId="4"><w:abstractNumId w:val="7"/><w:lvlOverride w:ilvl="1"><w:startOverride w:val="3"/></w:lvlOverride></w:num></w:numbering>"""
RELS = """<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="t" Target="./styles.xml"/>
<Relationship Id="r2" Type="t" Target="../up.xml"/><Relationship Id="r3" Type="t" Target="http://x.example/" TargetMode="External"/><Relationship Id="r4" Type="t" Target="gone.xml"/></Relationships>"""
BODY = f"""<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>a</w:t></w:r></w:p>
<w:p><w:pPr><w:pStyle w:val="H1"/><w:numPr><w:ilvl w:val="0"/></w:numPr></w:pPr></w:p><w:p><w:pPr><w:pStyle w:val="H1"/><w:numPr><w:numId w:val="0"/></w:numPr></w:pPr></w:p><w:p/></w:body></w:document>"""


def _parts(spark, folder):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in {"[Content_Types].xml": "<x/>", "_rels/.rels": "<x/>", "word/document.xml": BODY, "word/styles.xml": STYLES, "word/numbering.xml": NUMBERING, "word/_rels/document.xml.rels": RELS}.items():
            z.writestr(name, content)
    (folder / "a.docx").write_bytes(out.getvalue())
    return packages.parts(packages.files(spark, str(folder)))


def test_definitions(spark, tmp_path):
    parts = _parts(spark, tmp_path)
    styles = definitions.styles(parts)
    assert [(r.style_id, r.type, r.based_on, r.is_default, r.num_id, r.level) for r in styles.orderBy("style_id").collect()] == [("C", "character", None, False, None, None), ("H1", "paragraph", "N", True, "4", "1")]
    numbers = definitions.numbering(parts)
    assert {r.kind: r["count"] for r in numbers.groupBy("kind").count().collect()} == {"num": 1, "level": 2, "override": 1}
    got = definitions.effective_numbering(packages.paragraphs(parts), styles, numbers).orderBy("paragraph_index").collect()
    assert [(r.num_id, r.level, r.start, r.format, r.level_text) for r in got] == [("4", "1", "3", "upperLetter", "%2."), ("4", "0", "1", "decimal", "%1."), (None, None, None, None, None), (None, None, None, None, None)]


def test_relationships(spark, tmp_path):
    parts = _parts(spark, tmp_path)
    rels = definitions.relationships(parts)
    assert {r.rel_id: (r.resolved, r.fault) for r in rels.collect()} == {"r1": ("word/styles.xml", None), "r2": (None, "parent"), "r3": (None, None), "r4": ("word/gone.xml", None)}
    assert sorted(r.rel_id for r in writing.dangling(rels, parts).collect()) == ["r2", "r4"]


def test_section_inheritance(spark):
    sections = spark.createDataFrame([(1, "header", 0, "a"), (1, "header", 1, None), (1, "footer", 0, None), (1, "header", 2, "b"), (2, "header", 0, None)], "doc int, kind string, i int, ref string")
    got = definitions.section_inheritance(sections, "doc", "kind", "i", "ref").collect()
    assert {(r.doc, r.kind, r.i): r.ref for r in got} == {(1, "header", 0): "a", (1, "header", 1): "a", (1, "footer", 0): None, (1, "header", 2): "b", (2, "header", 0): None}


def test_patch_keeps_all_else(spark, tmp_path):
    parts = _parts(spark, tmp_path)
    path = parts.first().path
    new = spark.createDataFrame([(path, "word/styles.xml", bytearray(b"<s/>")), (path, "word/new.xml", bytearray(b"<broken>"))], "path string, part string, content binary")
    out = spark.createDataFrame([(path, "word/numbering.xml")], "path string, part string")
    made = writing.patched(parts, new, out)
    assert {r.part: r.origin for r in made.collect() if r.origin != "kept"} == {"word/styles.xml": "replaced", "word/new.xml": "added"}
    assert [r.part for r in writing.ill_formed(made).collect()] == ["word/new.xml"]
    with zipfile.ZipFile(io.BytesIO(writing.packed(made).first().package)) as z:
        assert z.namelist()[0] == "[Content_Types].xml"
        assert "word/numbering.xml" not in z.namelist()
        assert (z.read("word/document.xml").decode(), z.read("word/styles.xml")) == (BODY, b"<s/>")
