"""Environment of packages: read, put into others, read again."""

import pytest
from pyspark.sql import functions as F

from folioframe.sources import environment, packages, scanning, writing

from .test_shells import W, _again, _package, _rels

THEME = '<?xml version="1.0" encoding="UTF-8"?><a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" name="T$1\\x"><a:b/></a:theme>'
DEFAULTS = '<w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="22"/></w:rPr></w:rPrDefault> <w:pPrDefault/></w:docDefaults>'
FONT = '<w:font w:name="{}"><w:panose1 w:val="{}"/></w:font>'


def _folder(folder, name, sheet, **parts):
    _package(folder, name, '<w:p/><w:sectPr><w:pgSz w:w="3" w:h="4"/><w:cols w:num="2"/></w:sectPr>', {"word/styles.xml": f"<w:styles {W}>{sheet}</w:styles>"} | {k.replace("__", "/") + ".xml": v for k, v in parts.items()})


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("environment")
    settings = f'<w:settings {W}><w:zoom w:percent="90"/><w:compat><w:doNotExpandShiftReturn/><w:compatSetting w:name="mode" w:val="15"/></w:compat></w:settings>'
    _folder(folder, "template.docx", DEFAULTS, word__theme__theme1=THEME, word__settings=settings, word__fontTable=f"<w:fonts {W}>{FONT.format('A', 1)}{FONT.format('B', 1)}</w:fonts>", customXml__item1="<x/>")
    _folder(folder, "bare.docx", "")
    own = f'<w:settings {W}><w:documentProtection/><w:compat><w:other/></w:compat></w:settings>'
    _folder(folder, "full.docx", DEFAULTS.replace("22", "18"), word__theme__theme1=THEME.replace("T$1", "own"), word__settings=own, word__fontTable=f"<w:fonts {W}>{FONT.format('B', 2)}</w:fonts>", word___rels__document=_rels())
    _folder(folder, "odd.docx", "", word__fontTable=f'<w:fonts {W}><w:font w:name="E"><w:embedBold w:fontKey="x"/></w:font></w:fonts>', word__theme__theme2=THEME)
    return packages.parts(packages.files(spark, str(folder))).cache()


def _of(parts, name):
    return parts.where(F.col("path").endswith(f"/{name}.docx"))


def _told(parts, *kinds):
    return {(r.kind, r.key): r.value for r in environment.scanned(parts).where(F.col("kind").isin(*kinds)).collect()}


def test_scan(found):
    got = _told(_of(found, "template"), "defaults", "compat_flag", "setting", "font", "layout", "theme", "custom")
    assert {k for k in got if k[0] != "custom"} == {("defaults", "rPr"), ("defaults", "pPr"), ("compat_flag", "doNotExpandShiftReturn"), ("compat_flag", "mode"), ("setting", "zoom"), ("font", "A"), ("font", "B"), ("layout", "0/pgSz"), ("layout", "0/cols"), ("theme", "")}
    assert got["layout", "0/pgSz"] == '<w:pgSz w:w="3" w:h="4"/>' and got["theme", ""].startswith("<a:theme") and ("custom", "customXml/item1.xml") in got
    faults = environment.faults(environment.scanned(found))
    assert {(r.path.rsplit("/", 1)[1], r.code, r.detail) for r in faults.collect()} == {("odd.docx", "embedded_font", "E"), ("odd.docx", "two_themes", "word/theme/theme2.xml")}


def test_round_trip(spark, found, tmp_path):
    template = environment.scanned(_of(found, "template")).cache()
    targets = found.where(F.col("path").rlike("/(bare|full)[.]docx$"))
    made = _again(writing.patched(targets, environment.applied(targets, template))).cache()
    want = _told(_of(found, "template"), "defaults", "theme", "compat", "compat_flag")
    for name in ("bare", "full"):
        assert _told(_of(made, name), "defaults", "theme", "compat", "compat_flag") == want
    assert set(_told(_of(made, "bare"), "setting", "font")) == {("font", "A"), ("font", "B")}
    full = _told(_of(made, "full"), "setting", "font")
    assert set(full) == {("setting", "documentProtection"), ("font", "A"), ("font", "B")} and 'w:val="2"' in full["font", "B"]
    types = {r.path.rsplit("/", 1)[1]: bytes(r.content).decode() for r in made.where("part = '[Content_Types].xml'").collect()}
    assert types["bare.docx"].count("<Override PartName=\"/word/theme/theme1.xml\"") == types["bare.docx"].count("/word/settings.xml") == types["bare.docx"].count("/word/fontTable.xml") == 1 and "theme1" not in types["full.docx"]
    (rels,) = [bytes(r.content).decode() for r in _of(made, "bare").where("part = 'word/_rels/document.xml.rels'").collect()]
    assert rels.count("<Relationship ") == 3
    # A second time nothing changes, and what is written is well-formed.
    again = _again(writing.patched(made, environment.applied(made, template)))
    assert {(r.path, r.part): bytes(r.content) for r in again.collect()} == {(r.path, r.part): bytes(r.content) for r in made.collect()}
    assert writing.ill_formed(made).isEmpty()


def test_template_without_environment_changes_nothing(found):
    bare = environment.scanned(_of(found, "bare"))
    assert environment.applied(_of(found, "full"), bare).isEmpty()


def test_children():
    assert [(n, "<a><b>x<b/></b><!-- <c/> --><c/></a>"[a:z]) for n, a, z in scanning.children("<a><b>x<b/></b><!-- <c/> --><c/></a>")] == [("b", "<b>x<b/></b>"), ("c", "<c/>")]
    assert list(scanning.children("<a/>")) == []
    for bad in ("<a><b></a></b>", "<a>"):
        with pytest.raises(ValueError):
            list(scanning.children(bad))
