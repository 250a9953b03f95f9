"""Word packages written back: parts replaced, left out or added, all else unchanged.

The plan of what a package holds is a join of parts; one task packs one file.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def patched(package_parts: DataFrame, replacements: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """``path, part, content, origin`` after the patch.

    ``replacements`` (path, part, content) win over parts of the same name and
    add parts of new names; ``excluded`` (path, part) leave.  ``origin`` is
    ``kept``, ``replaced`` or ``added``.
    """
    new = replacements.select("path", "part", F.col("content").alias("new"))
    both = package_parts.where("fault IS NULL").select("path", "part", "content").join(new, ["path", "part"], "full_outer")
    origin = F.when(F.col("new").isNull(), "kept").when(F.col("content").isNull(), "added").otherwise("replaced")
    out = both.select("path", "part", F.coalesce("new", "content").alias("content"), origin.alias("origin"))
    return out if excluded is None else out.join(excluded.select("path", "part"), ["path", "part"], "left_anti")


def _ill_formed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        bad = []
        for path, part, content in batch.itertuples(index=False):
            try:
                ElementTree.fromstring(content)
            except ElementTree.ParseError as e:
                bad.append((path, part, str(e)))
        yield pd.DataFrame(bad, columns=["path", "part", "problem"])


def ill_formed(package_parts: DataFrame) -> DataFrame:
    """``path, part, problem`` of XML parts that do not parse."""
    xml = package_parts.where(F.col("part").rlike("[.](xml|rels)$")).select("path", "part", "content")
    return xml.mapInPandas(_ill_formed, "path string, part string, problem string")


def dangling(relationships: DataFrame, package_parts: DataFrame) -> DataFrame:
    """Internal relationships whose target the package lacks, or may not name."""
    have = package_parts.where("part IS NOT NULL").select("path", F.col("part").alias("resolved"))
    return relationships.where("NOT external").join(have, ["path", "resolved"], "left_anti")


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    out = io.BytesIO()
    if rows["part"].str.lower().duplicated().any():
        raise ValueError(f"{rows['path'].iloc[0]} holds a part twice")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for part, content in sorted(zip(rows["part"], rows["content"]), key=lambda p: (p[0] != "[Content_Types].xml", p[0])):
            z.writestr(zipfile.ZipInfo(part, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED)
    return pd.DataFrame({"path": [rows["path"].iloc[0]], "package": [out.getvalue()]})


def packed(package_parts: DataFrame) -> DataFrame:
    """``path, package``: one file's bytes per path, the same for the same parts.

    A package must fit a task, as it does when it is read.  Two parts of one
    name, letters folded, are an error.
    """
    return package_parts.select("path", "part", "content").groupBy("path").applyInPandas(_pack, "path string, package binary")
