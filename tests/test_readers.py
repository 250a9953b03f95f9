"""Discovery of files, and what readers and checks tell beyond the usual, by hand."""

import pytest
from pyspark.sql import functions as F

from folioframe.operators import restyle, shells
from folioframe.sources import definitions, discovery, packages, writing

from .test_shells import W, _again, _lists, _package, _rels


def test_discovery(spark, tmp_path):
    for name in ("b.docx", "A.DOCX", "~$b.docx", "c_FORMATTED.docx", "d_canadian_formatted.DOCX", "note.txt", "template.docx"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "inner").mkdir()
    (tmp_path / "inner" / "deep.docx").write_bytes(b"x")
    here = str(tmp_path)
    got = discovery.collected(spark, [here], [f"{here}/c_FORMATTED.docx", f"{here}/./b.docx", f"{here}/none.docx", f"{here}/inner/deep.docx"], f"{here}/template.docx")
    rows = {(r.path.rsplit("/", 1)[1], r.given): (r.code, r.place) for r in got.collect()}
    assert rows == {
        ("A.DOCX", False): (None, 1), ("b.docx", True): (None, 2), ("b.docx", False): ("repeated", None), ("c_FORMATTED.docx", True): (None, 3), ("c_FORMATTED.docx", False): ("own_output", None), ("deep.docx", True): (None, 4), ("none.docx", True): ("missing", None),
        ("~$b.docx", False): ("lock_file", None), ("d_canadian_formatted.DOCX", False): ("own_output", None), ("note.txt", False): ("not_a_docx", None), ("template.docx", False): ("excluded", None),
    }
    named = discovery.collected(spark, [], [f"{here}/template.docx"], f"{here}/template.docx").collect()
    assert [(r.code, r.place) for r in named] == [("template", None)]
    odd = spark.createDataFrame([(None, None), ("x/", False), ("hdfs://h/a//b.docx", False), ("/a/b.docx", None)], "path string, given boolean")
    assert sorted((str(r.path), r.code) for r in discovery.chosen(odd).collect()) == [("/a/b.docx", None), ("None", "no_path"), ("hdfs://h/a//b.docx", None), ("x/", "no_path")]


SHEET = (
    f'<w:styles {W}><w:latentStyles w:count="3"><w:lsdException w:name="Normal" w:uiPriority="0" w:qFormat="1"/></w:latentStyles><w:style w:type="paragraph" w:customStyle="1" w:styleId="P"><w:name w:val="P"/><w:uiPriority w:val="9"/><w:semiHidden w:val="0"/><w:unhideWhenUsed/><w:qFormat/></w:style>'
    '<w:style w:type="table" w:styleId="T"><w:name w:val="T"/><w:locked w:val="on"/></w:style></w:styles>'
)
LEVELS = f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:lvlRestart w:val="0"/><w:pStyle w:val="P"/><w:isLgl/><w:suff w:val="space"/></w:lvl></w:abstractNum><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"/></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num></w:numbering>'


def test_all_keys_of_styles_and_levels(spark, tmp_path):
    _package(tmp_path, "a.docx", "<w:p/>", {"word/styles.xml": SHEET, "word/numbering.xml": LEVELS})
    parts = packages.parts(packages.files(spark, str(tmp_path))).cache()
    got = {r.style_id: (r.is_custom, r.ui_priority, r.quick, r.hidden, r.unhide, r.locked) for r in definitions.styles(parts).collect()}
    assert got == {"P": (True, "9", True, False, True, False), "T": (False, None, False, False, False, True)}
    assert [r.style_id for r in definitions.table_styles(parts).collect()] == ["T"]
    assert {(r.name, r.attribute, r.value) for r in definitions.latent_styles(parts).collect()} == {(None, "count", "3"), ("Normal", "uiPriority", "0"), ("Normal", "qFormat", "1")}
    numbers = definitions.numbering(parts)
    assert {(r.owner, r.restart, r.suffix, r.legal, r.style) for r in numbers.where("kind = 'level'").collect()} == {("0", "0", "space", True, "P"), ("1", None, None, None, None)}
    used = parts.select("path").distinct().withColumn("num_id", F.lit("1"))
    assert {(r.kind, r.owner) for r in definitions.numbering_in_use(numbers, used).collect()} == {("num", "1"), ("level", "0")}


def test_content_types(spark, tmp_path):
    types = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="a"/><Default Extension="XML" ContentType="b"/><Override PartName="/word/Document.xml" ContentType="c"/><Override PartName="/word/gone.xml" ContentType="d"/><Override PartName="word/styles.xml" ContentType="e"/><Default Extension="png"/></Types>'
    _package(tmp_path, "a.docx", "<w:p/>", {"[Content_Types].xml": types, "word/media/a.png": b"x", "[trash]/00AF.dat": b"x"})
    got = {(r.code, r.detail) for r in restyle.content_type_problems(packages.parts(packages.files(spark, str(tmp_path)))).collect()}
    assert got == {("type_twice", "*.xml"), ("type_of_nothing", "word/gone.xml"), ("type_malformed", "word/styles.xml"), ("type_malformed", "png"), ("no_type", "word/media/a.png"), ("no_type", "_rels/.rels")}


@pytest.mark.parametrize("rels", [None, _rels(("s", "styles", "styles.xml"))])
def test_lists_come_to_a_package_without_any(spark, tmp_path, rels):
    _package(tmp_path, "template.docx", "<w:p/>", {"word/numbering.xml": _lists(3, 5, "AAAA0000")})
    _package(tmp_path, "target.docx", "<w:p/>", {} if rels is None else {"word/_rels/document.xml.rels": rels})
    parts = packages.parts(packages.files(spark, str(tmp_path))).cache()
    of = lambda n: parts.where(F.col("path").endswith(f"/{n}.docx"))
    path, template = of("target").first().path, of("template").first().path
    ids, made = shells.imported_lists(of("target"), of("template"), spark.createDataFrame([(path, template, "5")], "path string, template string, num_id string"))
    assert [(r.num_id, r.new_id) for r in ids.collect()] == [("5", "1")]
    after = _again(writing.patched(of("target"), made)).cache()
    numbers = definitions.numbering(after)
    assert {(r.kind, r.owner, r.abstract_id) for r in numbers.collect()} == {("num", "1", "0"), ("level", "0", None)}
    related = definitions.relationships(after).where("type LIKE '%/numbering'").collect()
    assert [(r.resolved, r.fault) for r in related] == [("word/numbering.xml", None)] and writing.ill_formed(after).isEmpty()
    assert not [r for r in restyle.content_type_problems(after).collect() if r.detail == "word/numbering.xml"]
