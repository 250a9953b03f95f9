"""Skip reasons, roles and typed numbers by hand, no-break spaces and dashes included."""

from pyspark.sql import functions as F

from folioframe.functions import roles
from folioframe.operators import conversion, registry

SKIPPED = {
    "[all of it]": "editor_note", "[not all": None, "EDITOR:": "editor_note", "Specifier note : x": "editor_note", "spec editor instruction: x": "editor_note", "Specification  Specifier Note:x": "editor_note", "Spec instruction: y": "editor_note", "editor note": None,
    "Hidden Editor Note": "editor_note", "Hidden editor notes": None, "Copyright 2020 by X": "copyright_notice", "Copyright 20 by X": None, "Exclusively published and distributed by X": "copyright_notice", "Retain one or more": "specifier_note", "Retain ones": None,
    "Retain definitions": "specifier_note", "Revise this section": "specifier_note", "Verify that Section": "specifier_note", "Specify parts in first": "specifier_note", "High-compressive-strength inserts may permit x": "specifier_note", "Insert the paragraphs below": "specifier_note",
    "The paragraph below": None, "Option: x may be used": "specifier_note", "Option: x": None, "As catalogs indicate": "specifier_note", "": "empty", "  ": "empty", None: "empty",
}
ROLES = {
    "SECTION 01 10 00": ("SectionID", None), "section 011000 - SUMMARY – OF": ("SectionID", "SUMMARY – OF"), "SECTION011000": ("SectionID", None), "SECTION 01–10–00: Sum mary": ("SectionID", "Sum mary"), "SECTION 01 10 00.13 X": ("SectionID", ".13 X"), "SECTION 0110001": (None, None), "SECTION 01 1": (None, None),
    "END OF SECTION": ("END_OF_SECTION", None), "End of Division 01 10 00 —": ("END_OF_SECTION", None), "END OF SECTION 01 10": (None, None), "PART 1 - GENERAL": ("PART", None), "Part IV: X": ("PART", None), "PART 1—X": ("PART", None), "PART 1": (None, None), "PART mixed": (None, None), "PART 1 -": ("PART", None), "PART 2GENERAL": (None, None),
    "1.01 SUMMARY": ("ARTICLE", None), "1.01": ("ARTICLE", None), "12.345 x": ("ARTICLE", None), "1.1 x": (None, None), "123.01 x": (None, None), "A. x": ("PARAGRAPH", None), "A) x": ("PARAGRAPH", None), "a. x": (None, None), "A.x": (None, None), None: (None, None),
}
BY_HAND = {"SECTION 01 10 00 X": True, "section 1: x": True, "SECTION 01": False, "PART 1": True, "PART 1x": False, "1.1 x": True, "1.1": False, "a. x": True, "A. x": True, "12. x": True, ".1 x": True, "(1) x": True, "(ab) x": True, "iv) x": True, "  xi.  y": True, "ab. x": False, "x": False, "": False, "A. ": True}


def test_skip_reasons(spark):
    frame = spark.createDataFrame([(t,) for t in SKIPPED], "t string").select("t", roles.skip_reason(F.col("t")).alias("r"))
    assert {r.t: r.r for r in frame.collect()} == SKIPPED


def test_roles_without_context(spark):
    frame = spark.createDataFrame([(t,) for t in ROLES], "t string").select("t", roles.ungated_role(F.col("t")).alias("r"), roles.section_title(F.col("t")).alias("s"))
    assert {r.t: (r.r, r.s) for r in frame.collect()} == ROLES


def test_typed_numbers(spark):
    frame = spark.createDataFrame([(t,) for t in BY_HAND], "t string").select("t", registry.by_hand(F.col("t")).alias("h"))
    assert {r.t: r.h for r in frame.collect()} == BY_HAND
    told = {"A. x": True, "A) x": True, "a) x": True, "(a) x": True, "(1)": True, ".5 x": True, "12.345 x": True, "1.x": False, "AB. x": False, "(A) x": False}
    frame = spark.createDataFrame([(t,) for t in told], "t string").select("t", F.col("t").rlike(conversion.ANY).alias("a"))
    assert {r.t: r.a for r in frame.collect()} == told
