"""Document defaults, inherited properties, sections, JSON digests, rules over rows."""

import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folioframe.functions import roles, texts
from folioframe.operators import graph, outline, rules
from folioframe.sources import definitions, packages, writing

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
STYLES = f"""<w:styles {W}><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Body"/><w:sz w:val="20"/></w:rPr></w:rPrDefault><w:pPrDefault><w:pPr><w:spacing w:after="80" w:line="240"/></w:pPr></w:pPrDefault></w:docDefaults>
  <w:style w:type="paragraph" w:styleId="Base"><w:rPr><w:sz w:val="24"/><w:b/></w:rPr></w:style>
  <w:style w:type="paragraph" w:styleId="Leaf"><w:basedOn w:val="Base"/><w:pPr><w:spacing w:after="0"/></w:pPr></w:style></w:styles>"""
MAIN = f"""<w:document {W}><w:body><w:p><w:pPr><w:sectPr><w:headerReference w:type="default" r:id="rId1"/><w:pgSz w:w="100" w:h="200"/></w:sectPr></w:pPr></w:p>
  <w:tbl><w:tr><w:tc><w:p><w:pPr><w:sectPr/></w:pPr></w:p></w:tc></w:tr></w:tbl>
  <w:p><w:pPr><w:sectPr><w:footerReference r:id="rId2"/><w:titlePg/></w:sectPr></w:pPr></w:p>
  <w:sectPr><w:headerReference w:type="default" r:id="rId3"/><w:pgSz w:w="9" w:h="8" w:orient="landscape"/><w:pgMar w:top="1" w:left="2"/><w:cols w:num="2"/></w:sectPr></w:body></w:document>"""


def _package(main=MAIN, styles=STYLES):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in (("[Content_Types].xml", "<Types/>"), ("_rels/.rels", "<Relationships/>"), ("word/document.xml", main), ("word/styles.xml", styles)):
            z.writestr(name, text)
    return out.getvalue()


@pytest.fixture(scope="module")
def parts(spark):
    damaged = bytearray(_package())
    damaged[60:64] = b"\xff\xff\xff\xff"
    rows = [("good", _package()), ("bad main", _package(main="<w:document><w:body>")), ("bad style", _package(styles="<a></b>")), ("damaged", bytes(damaged)), ("none", b"")]
    return packages.parts(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")).cache()


def test_unreadable_packages_are_faults(parts):
    faults = {r.path: r.fault for r in parts.where("fault is not null").collect()}
    assert faults["bad main"] == "malformed:word/document.xml" and faults["bad style"] == "malformed:word/styles.xml" and faults["none"] == faults["damaged"] == "not_a_package"
    assert packages.paragraphs(parts).select("path").distinct().collect()[0].path == "good"


def test_the_nearest_statement_wins_and_defaults_come_last(spark, parts):
    own = definitions.styles(parts).select("style_id", "based_on")
    line = graph.closure(own, "style_id", "based_on").withColumn("path", F.lit("good"))
    got = {(r.style_id, r.property, r.attribute): (r.value, r.origin) for r in definitions.effective_properties(line, definitions.style_properties(parts), definitions.document_defaults(parts)).collect()}
    shared = {("rFonts", "ascii"): ("Body", None), ("sz", "val"): ("24", "Base"), ("b", "val"): ("true", "Base"), ("spacing", "line"): ("240", None)}
    want = {(s, *k): v for s in ("Base", "Leaf") for k, v in shared.items()} | {("Base", "spacing", "after"): ("80", None), ("Leaf", "spacing", "after"): ("0", "Leaf")}
    assert got == want


def test_sections_and_their_headers(parts):
    got = {r.section_index: r for r in definitions.sections(parts).collect()}
    assert len(got) == 3 and (got[0].width, got[0].height, got[1].width, got[1].title_page) == ("100", "200", None, True)
    assert (got[2].orient, got[2].top, got[2].left, got[2].right, got[2].columns) == ("landscape", "1", "2", None, "2")
    refs = {(r.section_index, r.kind): r.rel_id for r in definitions.header_footer_refs(parts).collect()}
    assert refs == {(0, "header"): "rId1", (1, "header"): "rId1", (2, "header"): "rId3", (0, "footer"): None, (1, "footer"): "rId2", (2, "footer"): "rId2"}


def test_a_part_comes_once(spark):
    twice = spark.createDataFrame([("p", "a.xml", bytearray(b"1")), ("p", "A.xml", bytearray(b"2"))], "path string, part string, content binary")
    with pytest.raises(Exception, match="holds a part twice"):
        writing.packed(twice).collect()


def test_json_digests(spark):
    rows = ['{"b": 1, "a": [1, 2.5, "é"]}', '{"a":[1,2.5,"é"],"b":1}', "[NaN]", "no json", None, "3"]
    got = [r.x for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, v string").select("i", texts.canonical_json_sha256(F.col("v")).alias("x")).orderBy("i").collect()]
    want = hashlib.sha256(json.dumps(json.loads(rows[0]), ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert got[0] == got[1] == want and got[2:5] == [None, None, None] and got[5] == hashlib.sha256(b"3").hexdigest()


def test_skip_reasons(spark):
    want = {
        "": "empty", " \u00a0": "empty", "[Retain [one] of two]": "editor_note", "EDITOR: check": "editor_note", "Spec Note: x": "editor_note", "Hidden specifier note here": "editor_note",
        "Copyright 2020 by X": "copyright_notice", "Copyright is held": None, "Exclusively published and distributed by X": "copyright_notice",
        "Retain first paragraph": "specifier_note", "Retain existing walls": None, "Revise this line": "specifier_note", "Revise drawings": None, "Delete subparagraph below if none": "specifier_note",
        "Option: glass may be used": "specifier_note", "Option: glass": None, "Catalogs indicate so": "specifier_note", "A. Scope": None,
    }
    df = spark.createDataFrame([(x, False) for x in want] + [("cell", True), ("", True), ("flagless", None)], "t string, c boolean")
    got = {(r.t, r.c): r.x for r in df.select("t", "c", roles.skip_reason(F.col("t"), F.col("c")).alias("x")).collect()}
    assert got == {(x, False): y for x, y in want.items()} | {("cell", True): "in_table", ("", True): "empty", ("flagless", None): None}


def test_roles_and_counters(spark):
    want = {
        "SECTION 01 10 00": ("SectionID", None), "Section 011000 - SUMMARY": ("SectionID", None), "END OF SECTION": ("END_OF_SECTION", None), "END OF SECTION 01 10 00": ("END_OF_SECTION", None), "End of sections of pipe": (None, None),
        "PART 2 - GENERAL": ("PART", 2), "PART IV: X": ("PART", 4), "PART 3 3.1": ("PART", 3), "Part of it": (None, None), "1.02": ("ARTICLE", 2), "2.15 Items": ("ARTICLE", 15), "A. Scope": ("PARAGRAPH", 1), "1000. Item": (None, 1000),
    }
    df = spark.createDataFrame([(x,) for x in want], "t string").withColumn("r", roles.ungated_role(F.col("t")))
    assert {r.t: (r.r, r.n) for r in df.select("t", "r", roles.counter(F.col("r"), F.col("t")).alias("n")).collect()} == want
    labels = {"a": 1, "Z": 26, "AA": 27, "az": 52, "12": 12, "": None, "a1": None}
    assert {r.t: r.n for r in spark.createDataFrame([(x,) for x in labels], "t string").select("t", roles.ordinal(F.col("t")).alias("n")).collect()} == labels


def test_counters_begin_anew_under_each_parent(spark):
    lines = ["PART 1 - X", "1.01 ONE", "A. a", "1. n", "2. n", "B. b", "1. n", "1.02 TWO", "A. again", "C. gap", "1.04 FOUR"]
    df = spark.createDataFrame([(7, i, x) for i, x in enumerate(lines)], "doc_id int, paragraph_index int, text string")
    plan = [(r.paragraph_index, r.depth, r.nth, r.body) for r in outline.conversion_plan(df).orderBy("paragraph_index").collect()]
    assert plan == [(2, ".", 1, "a"), (3, ".1", 1, "n"), (4, ".1", 2, "n"), (5, ".", 2, "b"), (6, ".1", 1, "n"), (8, ".", 1, "again"), (9, ".", 2, "gap")]
    assert [tuple(r) for r in outline.sequence_violations(df).collect()] == [(7, 9, "PARAGRAPH", 2, 3)]
    assert [tuple(r) for r in outline.sequence_violations(df.where("paragraph_index <> 9")).collect()] == [(7, 10, "ARTICLE", 3, 4)]


def test_rules_over_rows(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, None), ("b", 1, "x"), ("b", 2, "x"), ("c", None, "y"), ("c", 3, "y")], "k string, v int, w string")
    assert {tuple(r) for r in rules.consensus(df, ["k"], ["v", "w"]).collect()} == {("a", 1, None), ("b", None, "x"), ("c", None, "y")}
    known = spark.createDataFrame([(1, None, "R"), (1, None, "R"), (1, "x", "P"), (1, "x", "Q")], "v int, w string, role string")
    got = {(r.k, r.v, r.w, r.role, r.conflict) for r in rules.exact_match(df, known, ["v", "w"], "role").collect()}
    assert got == {("a", 1, None, "R", False), ("b", 1, "x", None, True), ("b", 2, "x", None, False), ("c", None, "y", None, False), ("c", 3, "y", None, False)}
    rows = spark.range(1000).select((F.col("id") * 7 % 101).alias("x"))
    told = rules.numbered(rows, ["x"], "n").collect()
    assert [r.x for r in sorted(told, key=lambda r: r.n)] == sorted(r.x for r in rows.collect()) and sorted(r.n for r in told) == list(range(1000))
    held = {}
    for r in rules.chunks(rows, ["x"], size=30, step=10, name="n").collect():
        held.setdefault(r.chunk, set()).add(r.n)
    assert all(v == set(range(10 * c, min(1000, 10 * c + 30))) for c, v in held.items()) and len(held) == 100


def test_inheritance_has_no_cap_and_bears_cycles(spark):
    n = 3000
    chain = spark.createDataFrame([(i, i - 1 if i else None, "top" if i == 0 else None) for i in range(n)], "k int, up int, p string")
    assert graph.inherit(chain, "k", "up", ["p"]).where("p = 'top'").count() == n
    ring = spark.createDataFrame([(0, 2, None), (1, 0, "x"), (2, 1, None), (3, 4, None), (4, 3, None)], "k int, up int, p string")
    assert {r.k: r.p for r in graph.inherit(ring, "k", "up", ["p"]).collect()} == {0: "x", 1: "x", 2: "x", 3: None, 4: None}


def test_the_sessions_own_views_stay(spark):
    from folioframe.plans.catalogue import QUERIES

    spark.createDataFrame([(1,)], "mine int").createOrReplaceTempView("orders")
    assert QUERIES["run_status"](spark, "/root/testdata/sf0.001").count() > 1
    assert spark.table("orders").columns == ["mine"]
    spark.catalog.dropTempView("orders")
