"""Word packages as tables: parts, and the paragraphs of the main part.

A package is a ZIP file; Spark lists and reads the files, tasks open them.
Each file is one row of binary content, so a package must fit a task.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Limits of an acceptable package, and the parts that it must have.
MAX_ENTRIES, MAX_TOTAL, MAX_PART, MAX_RATIO = 10_000, 512 << 20, 128 << 20, 1000
REQUIRED = ("[Content_Types].xml", "_rels/.rels", "word/document.xml", "word/styles.xml")

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content`` of the folder's own .docx files, lock files left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "false").load(folder)
    return found.where("NOT path RLIKE '/~[$][^/]*$'").select("path", "content")


def _fault(package: zipfile.ZipFile) -> str | None:
    """The first rule that a package breaks, or None."""
    entries = package.infolist()
    names = [e.filename for e in entries]
    if len(entries) > MAX_ENTRIES:
        return "too_many_entries"
    if len({n.lower() for n in names}) < len(names):
        return "duplicate_member"
    if any(n.startswith("/") or ".." in n.split("/") or "\\" in n for n in names):
        return "unsafe_path"
    if sum(e.file_size for e in entries) > MAX_TOTAL or any(e.file_size > MAX_PART for e in entries):
        return "too_large"
    if any(e.file_size > MAX_RATIO * max(1, e.compress_size) for e in entries):
        return "ratio"
    return next((f"missing:{r}" for r in REQUIRED if r not in names), None)


def _is_read(part: str) -> bool:
    """Whether readers of this library parse the part."""
    return part.endswith(".rels") or part.startswith("word/") and part.count("/") == 1 and part.endswith(".xml")


def _well_formed(xml: bytes) -> bool:
    try:
        ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return False
    return True


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as package:
                    fault = _fault(package)
                    rows = [] if fault else [(path, e.filename, package.read(e), None) for e in package.infolist() if not e.is_dir()]
                    fault = next((f"malformed:{part}" for _, part, xml, _ in rows if _is_read(part) and not _well_formed(xml)), fault)
            except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError):
                fault = "not_a_package"
            rows = [] if fault else rows
            yield pd.DataFrame(rows or [(path, None, None, fault)], columns=["path", "part", "content", "fault"])


def parts(packages: DataFrame) -> DataFrame:
    """``path, part, content, fault``: all parts of sound packages, one row with ``fault`` for any other.

    A damaged member or a main part, style sheet or relationship file that does
    not parse is a fault, too, so that what reads the parts can rely on them.
    """
    return packages.select("path", "content").mapInPandas(_parts, "path string, part string, content binary, fault string")


def _paragraphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows, at = [], 0
            stack = [(ElementTree.fromstring(content), False)]
            while stack:
                node, in_table = stack.pop()
                if node.tag == f"{_W}p":
                    style = node.find(f"{_W}pPr/{_W}pStyle")
                    number, level = (node.find(f"{_W}pPr/{_W}numPr/{_W}{x}") for x in ("numId", "ilvl"))
                    get = lambda x: None if x is None else x.get(f"{_W}val")
                    rows.append((path, at, "".join(t.text or "" for t in node.iter(f"{_W}t")), get(style), get(number), get(level), in_table))
                    at += 1
                else:
                    stack += [(child, in_table or node.tag == f"{_W}tbl") for child in reversed(node)]
            yield pd.DataFrame(rows, columns=["path", "paragraph_index", "text", "style", "num_id", "level", "in_table"])


def paragraphs(package_parts: DataFrame) -> DataFrame:
    """``path, paragraph_index, text, style, num_id, level, in_table`` of each main part, in order."""
    main = package_parts.where("part = 'word/document.xml'").select("path", "content")
    return main.mapInPandas(_paragraphs, "path string, paragraph_index long, text string, style string, num_id string, level string, in_table boolean")
