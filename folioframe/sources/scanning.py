"""Paragraphs of the main part with their exact place in its text.

A tag scanner with a stack finds the outermost paragraphs, so what lies between
them can be written back unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup

_TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<(/?)([\w:.-]+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)


def spans(xml: str, name: str = "w:p") -> Iterator[tuple[int, int, bool]]:
    """``start, end, in_table`` of the outermost ``name`` elements; tags that don't match raise ValueError."""
    stack: list[str] = []
    opened, tables, begin, within = 0, 0, 0, False
    for tag in _TAG.finditer(xml):
        closing, which, rest = tag.groups()
        if which is None:
            continue
        if closing:
            if not stack or stack.pop() != which:
                raise ValueError(f"</{which}> closes nothing at {tag.start()}")
            tables -= which == "w:tbl"
            if which == name:
                opened -= 1
                if not opened:
                    yield begin, tag.end(), within
        elif rest.endswith("/"):
            if which == name and not opened:
                yield tag.start(), tag.end(), tables > 0
        else:
            stack.append(which)
            if which == name:
                if not opened:
                    begin, within = tag.start(), tables > 0
                opened += 1
            tables += which == "w:tbl"
    if stack:
        raise ValueError(f"<{stack[-1]}> is never closed")


def children(xml: str) -> Iterator[tuple[str, int, int]]:
    """``name, start, end`` of the elements directly below the outermost one; tags that don't match raise ValueError."""
    stack: list[str] = []
    begin = 0
    for tag in _TAG.finditer(xml):
        closing, which, rest = tag.groups()
        if which is None:
            continue
        if closing:
            if not stack or stack.pop() != which:
                raise ValueError(f"</{which}> closes nothing at {tag.start()}")
            if len(stack) == 1:
                yield which, begin, tag.end()
        elif rest.endswith("/"):
            if len(stack) == 1:
                yield which, tag.start(), tag.end()
        else:
            if len(stack) == 1:
                begin = tag.start()
            stack.append(which)
    if stack:
        raise ValueError(f"<{stack[-1]}> is never closed")


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, text in zip(batch["path"], batch["text"]):
            rows = [(path, i, a, b, text[a:b], t) for i, (a, b, t) in enumerate(spans(text))]
            yield pd.DataFrame(rows, columns=["path", "paragraph_index", "start", "end", "xml", "in_table"])


def main_text(package_parts: DataFrame) -> DataFrame:
    """``path, text`` of the main parts."""
    return package_parts.where("part = 'word/document.xml'").select("path", markup.decoded(F.col("content")).alias("text"))


def paragraph_markup(package_parts: DataFrame) -> DataFrame:
    """``path, paragraph_index, start, end, xml, in_table, has_section, has_drawing, has_textbox``, outermost paragraphs in order."""
    found = main_text(package_parts).mapInPandas(_scan, "path string, paragraph_index long, start long, end long, xml string, in_table boolean")
    inside = {"has_section": "<w:sectPr\\b", "has_drawing": "<w:(drawing|pict|object)\\b", "has_textbox": "<w:txbxContent\\b"}
    return found.select("*", *[F.col("xml").rlike(p).alias(n) for n, p in inside.items()])


def paragraph_profile(marked: DataFrame) -> DataFrame:
    """The projection of ``paragraph_markup`` that roles are given by: text of 200 letters at most, hints, flags."""
    text = markup.visible_text(F.col("xml"))
    told = marked.withColumn("whole", text)
    return told.select(
        "path", "paragraph_index", F.left("whole", F.lit(200)).alias("text"), (F.length("whole") > 200).alias("was_truncated"), markup.hints(F.col("xml")).alias("hints"),
        markup.uniform_run_properties(F.col("xml")).alias("uniform_run"), "in_table", "has_section", "has_drawing", "has_textbox",
        F.when(F.col("whole") != "", None).when(F.col("has_textbox"), "text_box").when(F.col("has_drawing"), "drawing").otherwise("empty").alias("empty_host"),
    )
