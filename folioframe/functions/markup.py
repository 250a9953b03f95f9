"""Column functions on XML parts and on the markup of single paragraphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements whose text a reader does not see, and words for "off".
HIDDEN = ("del", "moveFrom", "instrText", "drawing", "pict", "object")
OFF = ("false", "0", "off", "none")

_NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def decoded(content: Column) -> Column:
    """An XML part's bytes as text.

    A byte order mark decides, then the zero bytes of a leading ``<``, then the
    declaration, else UTF-8.  Bytes that the encoding lacks raise an error.
    """
    head = F.hex(F.substring(content, 1, 2))
    ascii_head = F.decode(F.substring(content, 1, 200), "ISO-8859-1")
    told = F.upper(F.regexp_extract(ascii_head, r"^<\?xml[^>]*encoding=[\"']([A-Za-z0-9._-]+)", 1))
    text = (
        F.when(head.isin("FEFF", "FFFE"), F.decode(content, "UTF-16")).when(head == "003C", F.decode(content, "UTF-16BE")).when(head == "3C00", F.decode(content, "UTF-16LE"))
        .when(told.isin("ISO-8859-1", "LATIN1"), F.decode(content, "ISO-8859-1")).otherwise(F.decode(content, "UTF-8"))
    )
    return F.regexp_replace(text, "^\ufeff", "")


def encoded(text: Column) -> Column:
    """``text`` in UTF-8, its declaration saying so."""
    return F.encode(F.regexp_replace(text, r"^(<\?xml[^>]*encoding=)[\"'][^\"']*[\"']", '$1"UTF-8"'), "UTF-8")


def canonical(xml: Column) -> Column:
    """Without revision ids, proofing marks and white space between tags: equal for equal content."""
    bare = F.regexp_replace(F.regexp_replace(xml, r'\s+w:rsid\w*="[^"]*"', ""), r"<w:proofErr\b[^>]*/>", "")
    return F.trim(F.regexp_replace(bare, r">\s+<", "><"))


def _unescaped(text: Column) -> Column:
    def piece(x: Column) -> Column:
        hexed, digits = F.regexp_extract(x, "^&#[xX]([0-9A-Fa-f]{1,6});", 1), F.regexp_extract(x, "^&#([0-9]{1,7});", 1)
        code = F.when(hexed != "", hexed).when(digits != "", F.hex(digits.cast("long")))
        return F.when(code.isNull(), x).otherwise(F.concat(F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"), F.regexp_replace(x, "^&#[^;]*;", "")))

    out = F.array_join(F.transform(F.split(text, "(?=&#)"), piece), "")
    for name, letter in _NAMED:
        out = F.replace(out, F.lit(name), F.lit(letter))
    return out


def _shown(xml: Column) -> Column:
    return F.regexp_replace(xml, rf"(?s)<w:({'|'.join(HIDDEN)})\b(?:[^>]*/>|[^>]*>.*?</w:\1>)", "")


def visible_text(xml: Column) -> Column:
    """What a reader sees of a paragraph: deleted and hidden parts left out, breaks as spaces, white space collapsed."""
    x = F.regexp_replace(xml, r"(?s)<w:pPr\b(?:[^>]*/>|[^>]*>.*?</w:pPr>)", "")
    x = _shown(x)
    x = F.regexp_replace(x, r"<w:(?:tab|br|cr)\b[^>]*/>", "<w:t> </w:t>")
    x = F.regexp_replace(x, r"<w:noBreakHyphen\b[^>]*/>", "<w:t>\u2011</w:t>")
    pieces = F.regexp_extract_all(x, F.lit(r"(?s)<w:t(?:\s[^>]*)?(?<!/)>(.*?)</w:t>"), F.lit(1))
    text = F.replace(_unescaped(F.array_join(pieces, "")), F.lit("\u00ad"), F.lit(""))
    return F.trim(F.regexp_replace(text, r"[\s\x{00A0}]+", " "))


def paragraph_properties(xml: Column) -> Column:
    """The inside of the paragraph's own properties, those of its mark left out; "" without any."""
    inner = F.regexp_extract(xml, r"(?s)^<w:p(?:\s[^>]*)?>\s*<w:pPr(?:\s[^>]*)?(?<!/)>(.*?)</w:pPr>", 1)
    return F.regexp_replace(inner, r"(?s)<w:rPr\b.*?</w:rPr>", "")


def runs(xml: Column) -> Column:
    """Array of the runs that show something, as markup."""
    every = F.regexp_extract_all(_shown(xml), F.lit(r"(?s)<w:r(?:\s[^>]*)?(?<!/)>.*?</w:r>"), F.lit(0))
    return F.filter(every, lambda r: r.rlike(r"(?s)<w:t(?:\s[^>]*)?>[^<]|<w:(?:tab|br)\b"))


def run_properties(run: Column) -> Column:
    return F.regexp_extract(run, r"(?s)<w:rPr(?:\s[^>]*)?(?<!/)>(.*?)</w:rPr>", 1)


def value(inner: Column, tag: str, attribute: str = "val") -> Column:
    """An attribute of the first ``tag``; null where either is absent."""
    found = F.regexp_extract(inner, rf"<w:{tag}(?:\s[^>]*)?/?>", 0)
    return F.nullif(F.regexp_extract(found, rf'w:{attribute}="([^"]*)"', 1), F.lit(""))


def on_off(inner: Column, tag: str) -> Column:
    """True where ``tag`` is present without a value or with one that is not off; null where absent."""
    found = F.regexp_extract(inner, rf"<w:{tag}(?:\s[^>]*)?/?>", 0)
    return F.when(found != "", ~F.coalesce(F.lower(value(inner, tag)), F.lit("true")).isin(*OFF))


def hints(xml: Column) -> Column:
    """Struct of the formatting that a paragraph and its first visible run state themselves."""
    p, r = paragraph_properties(xml), F.coalesce(run_properties(F.get(runs(xml), F.lit(0))), F.lit(""))
    sides = {"ind": ("left", "right", "firstLine", "hanging"), "spacing": ("before", "after", "line", "lineRule")}
    nested = [F.struct(*[value(p, tag, a).alias(a) for a in names]).alias(tag) for tag, names in sides.items()]
    flags = [on_off(r, tag).alias(name) for tag, name in (("b", "bold"), ("i", "italic"), ("caps", "caps"), ("u", "underline"))]
    return F.struct(value(p, "pStyle").alias("style"), value(p, "numId").alias("num_id"), value(p, "ilvl").alias("level"), value(p, "jc").alias("jc"), *nested, *flags, value(r, "sz").alias("sz"), value(r, "rFonts", "ascii").alias("font"))


def _signature(element: Column) -> Column:
    """An element with its attributes in order of their names."""
    attributes = F.array_sort(F.regexp_extract_all(element, F.lit(r'[\w:]+="[^"]*"'), F.lit(0)))
    return F.array_join(F.concat(F.array(F.regexp_extract(element, r"^<([\w:]+)", 1)), attributes), " ")


def uniform_run_properties(xml: Column) -> Column:
    """Signatures of the properties that all visible runs share, in the first run's order.

    A run without properties shares none.
    """

    def own(run: Column) -> Column:
        return F.transform(F.regexp_extract_all(run_properties(run), F.lit(r"<w:\w+(?:\s[^>]*)?/>"), F.lit(0)), _signature)

    each = F.transform(runs(xml), own)
    first = F.coalesce(F.get(each, F.lit(0)), F.array().cast("array<string>"))
    return F.aggregate(each, first, lambda acc, x: F.array_intersect(acc, x))


def property_names(inner: Column) -> Column:
    """Names of the elements directly or deeper inside properties, each once."""
    return F.array_distinct(F.regexp_extract_all(inner, F.lit(r"<w:(\w+)"), F.lit(1)))
