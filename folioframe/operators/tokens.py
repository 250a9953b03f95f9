"""Numbers and titles that headers and footers repeat: what they agree on, and their places replaced.

Every text of a package is a witness.  A number or title counts if it stands
there twice at least and no other does; where witnesses differ, the package gets
a code and no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup, textnodes
from ..sources import scanning
from . import shells

# How a section's number, a labelled section or division and a section's file name are written, and how often a witness must be heard.
NUMBER = r"\d{2}(?:[ \t\x{00A0}]*\d{2}){2}"
LABELLED = rf"(?i)\bSECTION\s+({NUMBER})(?!\d)"
DIVISION = r"(?i)\bDIVISION\s+(\d{2})(?!\d)"
FILE_NAME = rf"(?i)(?<!\d)({NUMBER})\s+([^\r\n<>]+?)\.docx\b"
SUPPORT = 2


def _boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, part, kind, text in b.itertuples(index=False):
            for at, (a, z, _) in enumerate(scanning.spans(text, "w:txbxContent")):
                shown = "".join(t for _, t, _ in textnodes.nodes(text[a:z])).strip()
                if shown:
                    rows.append((path, part, kind, at, shown))
        yield pd.DataFrame(rows, columns=["path", "part", "kind", "at", "text"])


def text_boxes(package_parts: DataFrame) -> DataFrame:
    """``path, part, kind, at, text``: the texts in text boxes of the headers and footers that a package shows; empty ones left out."""
    shown = shells.shown_parts(package_parts).select("path", "part", "kind").distinct()
    rows = package_parts.join(shown, ["path", "part"]).select("path", "part", "kind", markup.decoded(F.col("content")).alias("text"))
    return rows.mapInPandas(_boxes, "path string, part string, kind string, at int, text string")


def _key(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _same_title(a: Column, b: Column) -> Column:
    """Equal, or one is the other with an s behind it."""
    return (a == b) | (a == F.concat(b, F.lit("s"))) | (b == F.concat(a, F.lit("s")))


def inferred(texts: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """``path, section, forms, division, title, aliases, code``: what the texts of each package agree on.

    ``texts``: ``path, kind, text`` (``kind`` header or footer).  ``expected``:
    ``path, section`` (six digits), which settles the number.  ``section`` is
    the number in six digits, ``forms`` as it is written; ``title`` that of its
    file names, ``aliases`` it and the headers that correspond (equal but for
    case, spaces and a last s; two words or more, no digits).

    ``code``: ``ambiguous_section``, ``ambiguous_title``,
    ``ambiguous_division``, ``division_conflict``, or ``no_support`` where a
    number, file name or header isn't there ``SUPPORT`` times; then all else is
    null.  Sums are gathered per task, a text that is everywhere is a row a task.
    """
    heard = texts.where("text IS NOT NULL").groupBy("path", "kind", "text").agg(F.count("*").alias("n"))
    named = heard.select("path", "n", F.explode(F.regexp_extract_all("text", F.lit(LABELLED), 1)).alias("form")).groupBy("path", _digits(F.col("form")).alias("section")).agg(F.sum("n").alias("n"), F.collect_set("form").alias("forms"))
    if expected is not None:
        told = expected.select("path", F.col("section").alias("wanted"))
        named = named.join(told, "path", "left")
    else:
        named = named.withColumn("wanted", F.lit(None).cast("string"))
    some = named.groupBy("path").agg(F.max("wanted").alias("wanted"), F.count("*").alias("kinds"), F.collect_list(F.when(F.col("wanted").isNull() | (F.col("section") == F.col("wanted")), F.struct("section", "n", "forms"))).alias("own"))
    picked = F.get("own", F.lit(0))
    section = some.select("path", "wanted", F.when(F.col("wanted").isNull() & (F.col("kinds") > 1), "ambiguous_section").when(F.coalesce(picked["n"], F.lit(0)) < SUPPORT, "no_support").alias("code1"), picked["section"].alias("section"), picked["forms"].alias("forms"))

    # The number and the title of one file name, cut at its number's end.
    files = heard.select("path", "n", F.explode(F.regexp_extract_all("text", F.lit(FILE_NAME), 0)).alias("f"))
    files = files.select("path", "n", F.regexp_extract("f", FILE_NAME, 1).alias("form"), F.trim(F.regexp_extract("f", FILE_NAME, 2)).alias("title")).where("title <> ''").withColumn("section", _digits(F.col("form")))
    by_title = files.groupBy("path", "section", _key(F.col("title")).alias("key")).agg(F.sum("n").alias("n"), F.min("title").alias("title"), F.collect_set("form").alias("forms"))
    titles = by_title.groupBy("path", "section").agg(F.count("*").alias("titles"), F.min(F.struct("key", "n", "title")).alias("t"), F.flatten(F.collect_list("forms")).alias("file_forms"))
    got = section.join(titles, ["path", "section"], "left")
    code2 = F.when(F.col("titles") > 1, "ambiguous_title").when(F.coalesce("t.n", F.lit(0)) < SUPPORT, "no_support")
    got = got.select("path", "wanted", "section", F.array_sort(F.array_distinct(F.concat("forms", F.coalesce("file_forms", F.array().cast("array<string>"))))).alias("forms"), F.col("t.title").alias("title"), F.col("t.key").alias("key"), F.coalesce("code1", code2).alias("code"))

    able = (F.col("kind") == "header") & ~F.col("text").rlike(r"\d|(?i)\.docx\s*$") & (F.size(F.split(F.trim("text"), r"\s+")) > 1)
    heads = heard.where(able).groupBy("path", _key(F.col("text")).alias("head")).agg(F.sum("n").alias("n"), F.min(F.trim("text")).alias("form")).where(F.col("n") >= SUPPORT)
    alike = got.join(heads, "path").where(_same_title(F.col("head"), F.col("key"))).groupBy("path").agg(F.array_sort(F.collect_set("form")).alias("heads"))
    divisions = heard.select("path", F.explode(F.regexp_extract_all("text", F.lit(DIVISION), 1)).alias("d")).groupBy("path").agg(F.array_sort(F.collect_set("d")).alias("divisions"))
    full = got.join(alike, "path", "left").join(divisions, "path", "left")
    own = F.left("section", F.lit(2))
    # With an expected number other divisions may stand beside the one that fits.
    code3 = F.when(F.col("heads").isNull(), "no_support").when(F.col("wanted").isNull() & (F.size("divisions") > 1), "ambiguous_division").when(F.col("divisions").isNotNull() & ~F.array_contains("divisions", own), "division_conflict")
    coded = full.withColumn("code", F.coalesce("code", code3))
    keep = lambda c: F.when(F.col("code").isNull(), c)
    every = texts.select("path").distinct()
    out = coded.select("path", keep(F.col("section")).alias("section"), keep(F.col("forms")).alias("forms"), keep(F.when(F.array_contains("divisions", own), own)).alias("division"), keep(F.col("title")).alias("title"), keep(F.array_sort(F.array_union("heads", F.array("title")))).alias("aliases"), "code")
    return every.join(out.withColumn("there", F.lit(True)), "path", "left").withColumn("code", F.when(F.col("there").isNull(), "no_support").otherwise(F.col("code"))).drop("there")


def _literal(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\\[\](){}.*+?^$|#&~\- ])", r"\\$1")


def _as_text(text: Column) -> Column:
    """A replacement in which nothing stands for a group."""
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def _in_form(form: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``form``; as they are where they are not as many."""
    marks = F.split(form, "")
    at = lambda i: F.length(_digits(F.left(form, i)))
    put = F.array_join(F.transform(marks, lambda c, i: F.when(c.rlike("[0-9]"), F.substr(digits, at(i + 1), F.lit(1))).otherwise(c)), "")
    return F.when(F.length(_digits(form)) == F.length(digits), put).otherwise(digits)


def replaced(texts: DataFrame, tokens: DataFrame, new: DataFrame) -> DataFrame:
    """``texts`` with ``new_text``: the tokens of each package (``inferred``) as ``new`` (path, new_section, new_title) has them.

    A number is replaced where SECTION stands before it or one of the titles
    behind it, in its own separators; a title where it is the whole text (but
    for case and spaces) or follows the number in a file name; a division where
    DIVISION stands before it.  All else, and packages with a code or without
    new tokens, stay as they are.  Null new values replace nothing.
    """
    rows = texts.join(tokens.where("code IS NULL").drop("code"), "path", "left").join(new, "path", "left")
    none = F.array().cast("array<string>")
    forms, aliases = F.coalesce("forms", none), F.coalesce("aliases", none)
    title = F.coalesce("new_title", "title")
    digits = F.coalesce("new_section", "section")
    pairs = F.flatten(F.transform(forms, lambda f: F.transform(aliases, lambda a: F.struct(f.alias("f"), a.alias("a")))))
    in_files = F.aggregate(pairs, F.col("text"), lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"(?i)(?<!\w)"), _literal(p["f"]), F.lit(r"(\s+)"), _literal(p["a"]), F.lit(r"(\.docx\b)")), F.concat(_as_text(_in_form(p["f"], digits)), F.lit("$1"), _as_text(title), F.lit("$2"))))
    # Names of files are done: a number that still stands before a title does so in running text.
    scoped = F.aggregate(pairs, in_files, lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"(?<!\w)"), _literal(p["f"]), F.lit(r"(?=\s*"), _literal(p["a"]), F.lit(r"(?!\w))")), _as_text(_in_form(p["f"], digits))))
    labelled = F.aggregate(forms, scoped, lambda t, f: F.regexp_replace(t, F.concat(F.lit(r"(?i)(\bSECTION\s+)"), _literal(f), F.lit(r"(?!\w)")), F.concat(F.lit("$1"), _as_text(_in_form(f, digits)))))
    divided = F.when(F.col("division").isNotNull(), F.regexp_replace(labelled, F.concat(F.lit(r"(?i)(\bDIVISION\s+)"), F.col("division"), F.lit(r"(?!\d)")), F.concat(F.lit("$1"), F.left(digits, F.lit(2))))).otherwise(labelled)
    whole = F.exists(aliases, lambda a: _key(a) == _key(F.col("text")))
    told = F.when(F.col("section").isNull() | F.coalesce("new_section", "new_title").isNull(), F.col("text")).when(whole, title).otherwise(divided)
    return rows.select(*texts.columns, told.alias("new_text"))
