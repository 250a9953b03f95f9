"""What surrounds a document's paragraphs: defaults, theme, compatibility, settings, fonts, layout, pictures, custom data.

One long table holds it for any number of packages; ``applied`` puts a
template's environment into others by two rules: defaults, theme and
compatibility are the template's, fonts and all else the target's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from . import scanning

# Parts by kind, how they are declared and related, and the least of a settings part.
PARTS = {"theme": "word/theme/theme1.xml", "settings": "word/settings.xml", "fontTable": "word/fontTable.xml"}
CONTENT_TYPES = {
    "theme": "application/vnd.openxmlformats-officedocument.theme+xml", "settings": "application/vnd.openxmlformats-officedocument.wordprocessingml.settings+xml",
    "fontTable": "application/vnd.openxmlformats-officedocument.wordprocessingml.fontTable+xml",
}
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_TYPES, _RELS, _STYLES = "[Content_Types].xml", "word/_rels/document.xml.rels", "word/styles.xml"
#: Longest picture whose bytes are told as base64, beside its digest.
TOLD_MEDIA = 1 << 20

_EMBEDDED = re.compile(r"<w:embed(?:Regular|Bold|Italic|BoldItalic)\b")


def _attribute(xml: str, name: str) -> str | None:
    found = re.match(rf"<[^>]*?\b{name}=\"([^\"]*)\"", xml)
    return found and found[1]


def _rows(part: str, text: str) -> Iterator[tuple[str, str, str]]:
    """``kind, key, value`` of one part."""
    inner = [(name, text[a:z]) for name, a, z in scanning.children(text)]
    if part == _STYLES:
        for name, xml in inner:
            if name == "w:docDefaults":
                yield from (("defaults", child.removeprefix("w:").removesuffix("Default"), xml[a:z]) for child, a, z in scanning.children(xml))
    elif part == PARTS["fontTable"]:
        for name, xml in inner:
            yield ("embedded_font" if _EMBEDDED.search(xml) else "font", _attribute(xml, "w:name") or name, xml)
    elif part == PARTS["settings"]:
        for name, xml in inner:
            if name == "w:compat":
                yield ("compat", "", xml)
                yield from (("compat_flag", _attribute(xml[a:z], "w:name") or child.removeprefix("w:"), xml[a:z]) for child, a, z in scanning.children(xml))
            else:
                yield ("setting", name.removeprefix("w:"), xml)
    elif part == PARTS["theme"]:
        yield ("theme", "", text[text.index("<", text.find("?>") + 1) :])


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(path, part, *r) for path, part, text in b.itertuples(index=False) for r in _rows(part, text)]
        yield pd.DataFrame(rows, columns=["path", "part", "kind", "key", "value"], dtype=object)


def scanned(package_parts: DataFrame) -> DataFrame:
    """``path, part, kind, key, value`` of sound packages.

    ``defaults`` (rPr, pPr), ``theme``, ``compat`` whole and its
    ``compat_flag`` by name, ``setting`` by name, ``font`` by name
    (``embedded_font`` where its data is in the package, which can't be carried
    over), ``layout`` (section and property), ``media`` (length and digest;
    bytes as ``media_bytes`` in base64 up to ``TOLD_MEDIA``), ``custom`` (digest
    of a custom part), ``part`` (digest of any other).  Markup is canonical: no
    revision ids, no white space between tags.
    """
    sound = package_parts.where("fault IS NULL")
    read = sound.where(F.col("part").isin(_STYLES, *PARTS.values())).select("path", "part", markup.decoded(F.col("content")).alias("text"))
    marked = read.mapInPandas(_read, "path string, part string, kind string, key string, value string").withColumn("value", markup.canonical(F.col("value")))
    apart = r"(?s)<w:(tbl|drawing|pict|object|txbxContent)\b.*?</w:\1>"
    sections = scanning.main_text(sound).select("path", F.posexplode(F.regexp_extract_all(F.regexp_replace("text", apart, ""), F.lit(r"(?s)(<w:sectPr\b(?:[^>]*/>|.*?</w:sectPr>))"), 1)).alias("at", "xml"))
    layout = sections.select("path", "at", F.explode(F.regexp_extract_all("xml", F.lit(r"(<w:(?:pgSz|pgMar|cols|titlePg|docGrid|vAlign)\b[^>]*/>)"), 1)).alias("value"))
    layout = layout.select("path", F.lit("word/document.xml").alias("part"), F.lit("layout").alias("kind"), F.concat_ws("/", F.col("at").cast("string"), F.regexp_extract("value", r"<w:(\w+)", 1)).alias("key"), markup.canonical(F.col("value")).alias("value"))
    digest = F.concat_ws(" ", F.octet_length("content").cast("string"), F.sha2("content", 256))
    kind = F.when(F.col("part").startswith("word/media/"), "media").when(F.col("part").startswith("customXml/"), "custom").otherwise("part")
    bytes_told = sound.where(F.col("part").startswith("word/media/") & (F.octet_length("content") <= TOLD_MEDIA)).select("path", "part", F.lit("media_bytes").alias("kind"), F.col("part").alias("key"), F.base64("content").alias("value"))
    return marked.unionByName(layout).unionByName(sound.select("path", "part", kind.alias("kind"), F.col("part").alias("key"), digest.alias("value"))).unionByName(bytes_told)


def _wired(text: Column, have: Column, kinds: list[str], of_types: bool) -> Column:
    """Declarations (or relationships) of the parts that ``have`` (array of kinds) names, those that are there already left alone."""
    out = text
    for kind in kinds:
        part = PARTS[kind]
        if of_types:
            missing, more, end = ~F.contains(text, F.lit(f'PartName="/{part}"')), f'<Override PartName="/{part}" ContentType="{CONTENT_TYPES[kind]}"/>', "</Types>"
        else:
            missing, more, end = ~F.contains(text, F.lit(f'Type="{_OFFICE}/{kind}"')), f'<Relationship Id="rId_{kind}" Type="{_OFFICE}/{kind}" Target="{part.removeprefix("word/")}"/>', "</Relationships>"
        out = F.when(F.array_contains(have, kind) & missing, F.replace(out, F.lit(end), F.lit(more + end))).otherwise(out)
    return out


def applied(target_parts: DataFrame, template_environment: DataFrame) -> DataFrame:
    """``path, part, content``: replacements for ``writing.patched`` that give each target the environment of one template.

    ``template_environment``: ``scanned`` of that template.  Defaults and
    compatibility replace the target's own or come in (a settings part is made
    where there is none), the theme replaces or is added, fonts are added that
    the target doesn't name.  New parts are declared and related, once; other
    settings of the template are never taken.  What the template lacks changes
    nothing.  Targets that the wiring parts are missing of get them.
    """
    env = template_environment
    first = lambda kind, key=None: F.max(F.when((F.col("kind") == kind) & (F.lit(key is None) | (F.col("key") == F.lit(key))), F.col("value")))
    fonts = F.array_sort(F.collect_list(F.when(F.col("kind") == "font", F.struct("key", "value"))))
    one = env.agg(first("defaults", "rPr").alias("rpr"), first("defaults", "pPr").alias("ppr"), first("theme").alias("theme"), first("compat").alias("compat"), fonts.alias("fonts"))
    names = {_STYLES: "styles", PARTS["settings"]: "settings", PARTS["fontTable"]: "font_table", PARTS["theme"]: "own_theme", _TYPES: "types", _RELS: "rels"}
    own = target_parts.where("fault IS NULL").groupBy("path").agg(*[F.max(F.when(F.col("part") == part, F.col("content"))).alias(n) for part, n in names.items()])
    texts = own.select("path", *[markup.decoded(F.col(n)).alias(n) for n in names.values()])
    rows = texts.join(F.broadcast(one), F.lit(True))
    defaults = F.concat(F.lit("<w:docDefaults>"), F.coalesce("rpr", F.lit("<w:rPrDefault><w:rPr/></w:rPrDefault>")), F.coalesce("ppr", F.lit("<w:pPrDefault><w:pPr/></w:pPrDefault>")), F.lit("</w:docDefaults>"))
    block = r"(?s)<w:docDefaults\b(?:[^>]*/>|.*?</w:docDefaults>)"
    quoted = lambda c: F.regexp_replace(c, r"([\\$])", r"\\$1")  # noqa: E731  for use as a replacement
    styles = F.when(F.coalesce("rpr", "ppr").isNotNull(), F.when(F.rlike("styles", F.lit(block)), F.regexp_replace("styles", F.lit(block), quoted(defaults))).otherwise(F.regexp_replace("styles", F.lit(r"(<w:styles\b[^>]*>)"), F.concat(F.lit("$1"), quoted(defaults)))))
    settings = F.coalesce("settings", F.lit(f'<w:settings xmlns:w="{_W}"></w:settings>'))
    compat = r"(?s)<w:compat\b(?:[^>]*/>|.*?</w:compat>)"
    told = F.when(F.rlike(settings, F.lit(compat)), F.regexp_replace(settings, F.lit(compat), quoted(F.col("compat")))).otherwise(F.replace(F.regexp_replace(settings, r"(<w:settings\b[^>]*)/>\s*$", "$1></w:settings>"), F.lit("</w:settings>"), F.concat(F.col("compat"), F.lit("</w:settings>"))))
    settings = F.when(F.col("compat").isNotNull(), told)
    named = F.regexp_extract_all("font_table", F.lit(r'<w:font\s[^>]*?\bw:name="([^"]*)"'), 1)
    lacking = F.filter("fonts", lambda f: F.col("font_table").isNull() | ~F.array_contains(named, f["key"]))
    more = F.array_join(F.transform(lacking, lambda f: f["value"]), "")
    sheet = F.regexp_replace(F.coalesce("font_table", F.lit(f'<w:fonts xmlns:w="{_W}"></w:fonts>')), r"(<w:fonts\b[^>]*)/>\s*$", "$1></w:fonts>")
    font_table = F.when(F.size(lacking) > 0, F.replace(sheet, F.lit("</w:fonts>"), F.concat(more, F.lit("</w:fonts>"))))
    theme = F.when(F.col("theme").isNotNull(), F.concat(F.lit('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'), F.col("theme")))
    fresh = F.array_compact(F.array(F.when(F.col("own_theme").isNull() & theme.isNotNull(), "theme"), F.when(F.col("settings").isNull() & F.col("compat").isNotNull(), "settings"), F.when(F.col("font_table").isNull() & (F.size("fonts") > 0), "fontTable")))
    types = F.coalesce("types", F.lit('<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"></Types>'))
    rels = F.coalesce("rels", F.lit('<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"></Relationships>'))
    opened = lambda x, tag: F.regexp_replace(x, rf"(<{tag}\b[^>]*)/>\s*$", rf"$1></{tag}>")
    kinds = list(PARTS)
    made = {_STYLES: styles, PARTS["settings"]: settings, PARTS["fontTable"]: font_table, PARTS["theme"]: theme, _TYPES: F.when(F.size(fresh) > 0, _wired(opened(types, "Types"), fresh, kinds, True)), _RELS: F.when(F.size(fresh) > 0, _wired(opened(rels, "Relationships"), fresh, kinds, False))}
    pairs = F.array(*[F.struct(F.lit(part).alias("part"), text.alias("text")) for part, text in made.items()])
    return rows.select("path", F.explode(pairs).alias("p")).where("p.text IS NOT NULL").select("path", "p.part", markup.encoded(F.col("p.text")).alias("content"))


def faults(environment: DataFrame, most_media: int = 10 << 20) -> DataFrame:
    """``path, code, detail``: ``embedded_font``, ``two_themes`` or ``media_too_large`` (of ``most_media`` bytes) in a scanned environment."""
    size = F.split_part("value", F.lit(" "), F.lit(1)).cast("long")
    code = F.when(F.col("kind") == "embedded_font", "embedded_font").when((F.col("kind") == "part") & F.col("key").rlike(r"^word/theme/theme[2-9]\d*\.xml$"), "two_themes").when((F.col("kind") == "media") & (size > most_media), "media_too_large")
    return environment.select("path", code.alias("code"), F.col("key").alias("detail")).where("code IS NOT NULL")
