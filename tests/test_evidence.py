"""Evidence operators on cases written down by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from folioframe.functions import audits, names, numbering, roles
from folioframe.operators import outline, rules, snapshots

ROWS = "doc_id int, paragraph_index int, text string, numbering_role string, in_table boolean"


def _paragraphs(spark, *texts):
    return spark.createDataFrame([(1, i, *(t if isinstance(t, tuple) else (t, None)), False) for i, t in enumerate(texts)], ROWS)


def _by_index(df, *cols):
    return {r.paragraph_index: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_signatures_with_nulls(spark):
    rows = [("decimal", " ( %7 ) ", 6), ("decimal", None, None), (None, None, 3), ("lowerLetter", "%12)", 1), (" Decimal ", "%1.%2", None), ("decimal", ".%1", None)]
    got = spark.createDataFrame(rows, "f string, t string, l int").select(numbering.role_of_signature(F.col("f"), F.col("t"), F.col("l")).alias("r"))
    assert [r.r for r in got.collect()] == ["SUBPARAGRAPH_LEVEL_7", None, None, "SUBSUBPARAGRAPH", None, None]


def test_numbering_outranks_text(spark):
    got = _by_index(outline.gated_roles(_paragraphs(spark, "1. not yet", ("Scope", "PARAGRAPH"), "1. now", ("A. text", "SUBSUBPARAGRAPH"), "a. below", "[A. note]", ("GENERAL", "PART"), "(1) no", ("x", "SUBPARAGRAPH"), "(1) deep")), "role")
    assert got == {0: None, 1: "PARAGRAPH", 2: "SUBPARAGRAPH", 3: "SUBSUBPARAGRAPH", 4: "SUBSUBPARAGRAPH", 5: None, 6: "PART", 7: None, 8: "SUBPARAGRAPH", 9: "SUBPARAGRAPH_LEVEL_7"}


def test_hits_and_titles(spark):
    got = outline.strong_hits(_paragraphs(spark, "SECTION 01 10 00 - SUMMARY", "A. Alpha", "SECTION 02 10 00", "Work", "A. Beta", "SECTION 03 10 00", "Other"))
    assert {(r.role, r.paragraph_index, r.nth) for r in got.collect()} == {("SectionID", 0, 1), ("SectionID", 2, 2), ("SectionID", 5, 3), ("SectionTitle", 0, 1), ("SectionTitle", 3, 2), ("PARAGRAPH", 1, 1), ("PARAGRAPH", 4, 2)}


def test_headings_of_targets(spark):
    lines = [("SECTION 011000 SUMMARY", None), ("SECTION 01 10 00 applies here", None), ("SUMMARY OF WORK", "SECTION 01 10 00"), ("Summary", "SECTION 01 10 00"), ("PART 4 - X", None), ("part 2", None), ("1.1 x", None), (None, None), ("(a) x", "y")]
    got = spark.createDataFrame(lines, "t string, p string").select(roles.heading_role(F.col("t"), F.col("p")).alias("r"))
    assert [r.r for r in got.collect()] == ["SectionID", None, "SectionTitle", None, None, "PART", "ARTICLE", None, "SUBPARAGRAPH_LEVEL_8"]


def test_faults_of_sequences(spark):
    got = outline.sequence_faults(_paragraphs(spark, "1.01 early", "PART 1 - X", "2.01 other", "1.02 fine", "B. skipped", "C. next", "(a) deep", ("auto", "PARAGRAPH"), "PART II - Y", "2.01 z", "A. a"))
    assert {(r.paragraph_index, r.code) for r in got.collect()} == {(0, "no_parent"), (2, "wrong_part"), (4, "gap"), (6, "no_parent"), (7, "mixed_sources")}
    assert outline.sequence_faults(_paragraphs(spark, "A. without", "B. articles", "1. x", "a. y").limit(0)).isEmpty()
    assert outline.sequence_faults(_paragraphs(spark, "A. without", "B. articles", "1. x", "a. y")).isEmpty()


def test_output_names(spark):
    long = "🎉" * 200
    paths = ["/a b!/Spec.docx", "/c/SPEC.docx", "/c/other", f"/c/{long}.docx", None]
    got = {r.path: r.output_name for r in names.output_names(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    digest = hashlib.sha1(b"/a b!/Spec.docx").hexdigest()[:8]
    assert got["/a b!/Spec.docx"] == f"Spec__a-b-{digest}_FORMATTED.docx" and got["/c/other"] == "other_FORMATTED.docx" and got[None] is None
    name = got[f"/c/{long}.docx"]
    tail = "__" + hashlib.sha256((long + "_FORMATTED.docx").encode()).hexdigest()[:12] + "_FORMATTED.docx"
    assert name == "🎉" * ((240 - len(tail)) // 2) + tail and len(name.encode("utf-16-le")) // 2 in (239, 240)
    named = spark.createDataFrame([("/o/x_FORMATTED.docx", "A"), ("/i/x.docx", "x_FORMATTED.docx"), ("/i/b", "a")], "path string, output_name string")
    assert {(r.name, r.n, r.code) for r in names.name_collisions(named, "/o/").collect()} == {("a", 2, "shared"), ("x_formatted.docx", 1, "input")}


def test_safe_details(spark):
    given = {"Preview": "1", "status": "ok", "reason": "because", "role": "two words", "n": "-1.5e3", "free": "word", "kind": None}
    row = spark.createDataFrame([(given,), (None,), ({},)], "d map<string,string>").select(
        audits.safe_details(F.col("d")).alias("s"), audits.with_defaults(F.col("d"), F.create_map(F.lit("n"), F.lit("0"), F.lit("m"), F.lit("1"))).alias("w"), audits.key_faults(F.col("d"), ("n", "z"), ("status",)).alias("f"),
    ).collect()
    assert row[0].s == {"status": "ok", "reason": "unspecified", "n": "-1.5e3", "kind": None} and row[1].s is None and row[2].s == {}
    assert row[0].w == given | {"m": "1"} and row[1].w == row[2].w == {"n": "0", "m": "1"}
    assert row[0].f == ["missing:z", "unknown:Preview", "unknown:free", "unknown:kind", "unknown:reason", "unknown:role"] and row[1].f == ["missing:n", "missing:z"]
    order = spark.range(1).select(audits.in_order(F.array(*map(F.lit, ("z", "cols", None, "a", "pgSz", "cols"))), ("pgSz", "cols")).alias("o")).first().o
    assert order == ["pgSz", "cols", "cols", "a", "z", None]


def test_digests(spark):
    def told(rows):
        return snapshots.digests(spark.createDataFrame(rows, "o string, k int, v string"), ["o"], F.col("k"), F.col("v"))

    one = told([("a", 1, "x"), ("a", 2, None), ("b", 1, ""), ("c", 1, "x"), ("c", 1, "x")])
    assert snapshots.changed_owners(one, told([("c", 1, "x"), ("a", 2, None), ("b", 1, ""), ("c", 1, "x"), ("a", 1, "x")]), ["o"]).isEmpty()
    other = told([("a", 1, "x"), ("a", 2, ""), ("b", 1, None), ("c", 1, "x"), ("d", 1, "x")])
    assert {r.o for r in snapshots.changed_owners(one, other, ["o"]).collect()} == {"a", "b", "c", "d"}
    assert snapshots.changed_owners(one, told([]), ["o"]).count() == 3


@pytest.mark.parametrize("taken_salts", [0, 1, 3])
def test_fresh_ids_try_again(spark, taken_salts):
    digest = lambda x: hashlib.sha1(x.encode()).hexdigest()[:8].upper()
    taken = [(digest(f"x#{s}" if s else "x"),) for s in range(taken_salts)]
    got = rules.fresh_ids(spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "name string"), spark.createDataFrame(taken, "id string"), "name")
    assert {r.name: r.id for r in got.collect()} == {"x": digest(f"x#{taken_salts}" if taken_salts else "x"), "y": digest("y")}
    assert rules.fresh_ids(spark.createDataFrame([], "name string"), spark.createDataFrame(taken, "id string"), "name").isEmpty()
