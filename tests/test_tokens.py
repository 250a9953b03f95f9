"""What headers and footers agree on, by hand."""

from folioframe.operators import tokens
from folioframe.sources import packages

from .test_shells import W, _package, _rels, _run

GOOD = [("header", "SECTION 01 10 00"), ("header", "Summary of Works"), ("header", "summary  OF works"), ("footer", "Section 011000"), ("footer", "01 10 00 Summary of Work.docx"), ("footer", "01 10 00 SUMMARY of work.DOCX"), ("header", "DIVISION 01"), ("header", "Another Title Here")]
CASES = {
    "good": (GOOD, ("011000", ["01 10 00", "011000"], "01", "SUMMARY of work", ["SUMMARY of work", "Summary of Works"], None)),
    "two numbers": ([*GOOD, ("header", "SECTION 02 20 00")], "ambiguous_section"), "once": ([x for x in GOOD if x[1] != "Section 011000"], "no_support"), "two titles": ([*GOOD, ("footer", "011000 Other.docx")], "ambiguous_title"),
    "title once": ([x for x in GOOD if not x[1].endswith("DOCX")], "no_support"), "no header": ([x for x in GOOD if "orks" not in x[1]], "no_support"), "two divisions": ([*GOOD, ("footer", "division 02")], "ambiguous_division"),
    "other division": ([("header", "DIVISION 03") if x[1].startswith("DIV") else x for x in GOOD], "division_conflict"), "nothing": ([("header", "plain text")], "no_support"), "null": ([("header", None)], "no_support"),
}


def _texts(spark, cases):
    return spark.createDataFrame([(name, kind, at, text) for name, rows in cases.items() for at, (kind, text) in enumerate(rows)], "path string, kind string, at int, text string")


def test_inferred(spark):
    got = {r.path: r for r in tokens.inferred(_texts(spark, {k: v[0] for k, v in CASES.items()})).collect()}
    assert set(got) == set(CASES)
    for name, (_, want) in CASES.items():
        r = got[name]
        if isinstance(want, str):
            assert (r.code, r.section, r.forms, r.title, r.aliases, r.division) == (want, None, None, None, None, None), name
        else:
            assert (r.section, r.forms, r.division, r.title, r.aliases, r.code) == want, name


def test_an_expected_number_settles_it(spark):
    rows = _texts(spark, {"a": CASES["two numbers"][0], "b": CASES["two divisions"][0], "c": GOOD, "d": CASES["two numbers"][0]})
    expected = spark.createDataFrame([("a", "011000"), ("b", "011000"), ("c", "033000"), ("d", "022000")], "path string, section string")
    got = {r.path: (r.section, r.division, r.code) for r in tokens.inferred(rows, expected).collect()}
    assert got == {"a": ("011000", "01", None), "b": ("011000", "01", None), "c": (None, None, "no_support"), "d": (None, None, "no_support")}


def test_replaced(spark):
    more = [("header", "see 01 10 00 and SECTION 01 10 001"), ("footer", "01 10 00 Summary of Works, page"), ("header", "SECTION\t01 10 00 - 011000"), ("footer", "DIVISION 01 of DIVISION 012"), ("header", "01 10 00 Summary of Worksheet")]
    rows = _texts(spark, {"good": GOOD + more, "once": CASES["once"][0]})
    new = spark.createDataFrame([("good", "033000", "Concrete $1\\x"), ("once", "033000", "x")], "path string, new_section string, new_title string")
    got = {(r.path, r.at): r.new_text for r in tokens.replaced(rows, tokens.inferred(_texts(spark, {"good": GOOD, "once": CASES["once"][0]})), new).collect()}
    title = "Concrete $1\\x"
    want = ["SECTION 03 30 00", title, title, "Section 033000", f"03 30 00 {title}.docx", f"03 30 00 {title}.DOCX", "DIVISION 03", "Another Title Here", "see 01 10 00 and SECTION 01 10 001", "03 30 00 Summary of Works, page", "SECTION\t03 30 00 - 011000", "DIVISION 03 of DIVISION 012", "01 10 00 Summary of Worksheet"]
    assert [got["good", i] for i in range(len(want))] == want
    assert all(got["once", i] == text for i, (_, text) in enumerate(CASES["once"][0]))
    kept = tokens.replaced(rows, tokens.inferred(_texts(spark, {"good": GOOD})), new.limit(0))
    assert all(r.new_text == r.text for r in kept.collect())


def test_text_boxes_of_packages(spark, tmp_path):
    box = lambda t: f"<w:p><w:r><w:pict><w:txbxContent><w:p>{_run(t[:4])}{_run(t[4:])}</w:p></w:txbxContent></w:pict></w:r></w:p>"
    header = f"<w:hdr {W}>{box('SECTION 01 10 00')}{box('    ')}{box('Summary &amp; Work')}</w:hdr>"
    _package(tmp_path, "a.docx", "<w:p/>", {"word/_rels/document.xml.rels": _rels(("h", "header", "header1.xml")), "word/header1.xml": header, "word/header2.xml": header})
    got = tokens.text_boxes(packages.parts(packages.files(spark, str(tmp_path)))).collect()
    assert [(r.part, r.kind, r.at, r.text) for r in got] == [("word/header1.xml", "header", 0, "SECTION 01 10 00"), ("word/header1.xml", "header", 2, "Summary & Work")]
