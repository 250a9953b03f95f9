import pytest
from pyspark.sql import functions as F

from folioframe.functions import markup
from folioframe.operators import restyle
from folioframe.sources import packages, scanning, writing

from .test_packages import _parts

P = (
    '<w:p w:rsidR="1"><w:pPr><w:pStyle w:val="H1"/><w:jc w:val="center"/><w:ind w:left="720" w:hanging="360"/><w:rPr><w:b/></w:rPr></w:pPr>'
    '<w:r><w:rPr><w:b/><w:i w:val="0"/><w:sz w:val="20"/></w:rPr><w:t xml:space="preserve">A.  x &amp;#233; &#233;&#x1F389;&lt;</w:t><w:tab/><w:t>b</w:t><w:softHyphen/></w:r>'
    '<w:del><w:r><w:delText>gone</w:delText><w:t>gone</w:t></w:r></w:del><w:r><w:rPr><w:sz w:val="20"/><w:b/></w:rPr><w:noBreakHyphen/><w:t>c</w:t></w:r></w:p>'
)


def test_paragraph_markup(spark):
    row = spark.createDataFrame([(P,)], "x string").select(
        markup.visible_text(F.col("x")).alias("text"), markup.hints(F.col("x")).alias("h"), markup.uniform_run_properties(F.col("x")).alias("u"), markup.canonical(F.col("x")).alias("c")
    ).first()
    assert row.text == "A. x &#233; é🎉< b\u2011c"
    assert (row.h.style, row.h.jc, row.h.ind.left, row.h.ind.right, row.h.bold, row.h.italic, row.h.caps, row.h.sz) == ("H1", "center", "720", None, True, False, None, "20")
    assert row.u == ["w:b", 'w:sz w:val="20"'] and "rsid" not in row.c


def test_runs_without_properties_share_none(spark):
    x = "<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>a</w:t></w:r><w:r><w:t>b</w:t></w:r></w:p>"
    got = spark.createDataFrame([(x,), ("<w:p/>",), (None,)], "x string").select(markup.uniform_run_properties(F.col("x")).alias("u"), markup.visible_text(F.col("x")).alias("t")).collect()
    assert got[0].u == got[1].u == [] and [r.t for r in got] == ["ab", "", None]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "iso-8859-1"])
def test_bytes_become_text(spark, encoding):
    told = encoding if encoding == "iso-8859-1" else "utf-16"
    text = f'<?xml version="1.0" encoding="{told if encoding != "utf-8" else "UTF-8"}"?><a>é</a>' if not encoding.startswith("utf-8") else "<a>é</a>"
    got = spark.createDataFrame([(bytearray(text.encode(encoding)),)], "b binary").select(markup.decoded(F.col("b")).alias("t")).first().t
    assert got == text
    again = spark.createDataFrame([(text,)], "t string").select(markup.encoded(F.col("t")).alias("b")).first().b.decode()
    assert again.endswith("<a>é</a>") and ("<?xml" not in again or 'encoding="UTF-8"' in again)


def test_spans_and_mismatched_tags():
    xml = "<w:body><w:p>a<w:p>in</w:p></w:p><!-- <w:p> --><w:tbl><w:p/></w:tbl><w:p a='>'>b</w:p></w:body>"
    assert [(xml[a:b], t) for a, b, t in scanning.spans(xml)] == [("<w:p>a<w:p>in</w:p></w:p>", False), ("<w:p/>", True), ("<w:p a='>'>b</w:p>", False)]
    for bad in ("<a><b></a></b>", "<a>", "</a>"):
        with pytest.raises(ValueError):
            list(scanning.spans(bad))


def test_restyle_changes_only_what_it_may(spark, tmp_path):
    parts = _parts(spark, tmp_path).cache()
    path = parts.first().path
    before = scanning.paragraph_markup(parts).cache()
    assert [r.paragraph_index for r in before.orderBy("start").collect()] == [0, 1, 2, 3]
    fields = "path string, paragraph_index long, new_style string, supplied_paragraph array<string>, supplied_run array<string>"
    assigned = spark.createDataFrame([(path, 0, "New", ["jc", "numPr"], None), (path, 3, 'Q"&$1', None, ["b"])], fields)
    changed = restyle.edits(before, assigned)
    made = writing.patched(parts, restyle.spliced(parts, changed)).withColumn("fault", F.lit(None).cast("string"))
    got = packages.paragraphs(made).orderBy("paragraph_index").collect()
    assert [(r.style, r.num_id, r.level) for r in got] == [("New", None, None), ("H1", None, "0"), ("H1", "0", None), ('Q"&$1', None, None)]
    after = scanning.paragraph_markup(made).cache()
    kept = {r.paragraph_index: r.xml for r in before.collect()}
    assert all(r.xml == kept[r.paragraph_index] for r in after.collect() if r.paragraph_index in (1, 2))
    assert restyle.drift(before, after, assigned).isEmpty()
    hurt = after.withColumn("xml", F.when(F.col("paragraph_index") == 0, F.replace("xml", F.lit(">a<"), F.lit(">z<"))).when(F.col("paragraph_index") == 1, F.regexp_replace("xml", "<w:numPr>.*</w:numPr>", "<w:jc/>")).otherwise(F.col("xml"))).where("paragraph_index < 3")
    assert {(r.paragraph_index, r.code) for r in restyle.drift(before, hurt, assigned).collect()} == {(0, "text"), (1, "property_added"), (1, "property_removed"), (3, "removed")}


def test_problems_of_a_package(spark, tmp_path):
    got = {(r.code, r.detail) for r in restyle.package_problems(_parts(spark, tmp_path)).collect()}
    assert got == {("style_based_on", "N"), ("relationship", "word/_rels/document.xml.rels#r2"), ("relationship", "word/_rels/document.xml.rels#r4")}


def test_style_import(spark):
    styles = spark.createDataFrame([("t", "a", "b", None, None), ("t", "b", "a", "c", "gone"), ("t", "c", None, None, None), ("t", "d", None, None, "a")], "path string, style_id string, based_on string, link string, next string")
    got = restyle.closure(styles, spark.createDataFrame([("t", "a")], "path string, style_id string"))
    assert sorted(r.style_id for r in got.collect()) == ["a", "b", "c"]
    names = {r.style_id: r.new_id for r in restyle.import_names(got, spark.createDataFrame([("b",), ("z",)], "style_id string")).collect()}
    assert names["a"] == "a" and names["c"] == "c" and names["b"].startswith("b__") and len(names["b"]) == 13


def test_two_rules_of_precedence(spark):
    target, template = (spark.createDataFrame(x, "k string, v int") for x in ([("a", 1), ("b", 2)], [("b", 3), ("c", 4), ("d", 5)]))
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(restyle.merged(target, template, "k", "target")) == {("a", 1), ("b", 2), ("c", 4), ("d", 5)}
    assert rows(restyle.merged(target, template, "k", "template", ["b", "c"])) == {("a", 1), ("b", 3), ("c", 4)}
