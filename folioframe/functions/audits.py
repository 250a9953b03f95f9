"""What of an audit may be shown, and contracts of maps and arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys whose values may be words, key parts that hint at texts of documents, stated reasons.
SAFE_KEYS = ("category", "code", "conversion_mode", "csi_role", "disposition", "kind", "method", "numbering_provenance", "policy", "property", "reason", "role", "source_kind", "status", "style_id", "target_kind")
TELLING = ("text", "preview", "excerpt", "content", "paragraph_xml")
REASONS = ("boilerplate", "drawing_or_textbox_subtree", "editorial_comment_style", "end_of_section_no_role", "non_csi_content", "section_header_no_role", "section_title_no_role", "table")

_NUMBER = r"^(-?[0-9]+([.][0-9]+)?([eE][-+]?[0-9]+)?|true|false|null)$"
_WORD = r"^[A-Za-z0-9_.:/#@+-]{1,160}$"


def safe_details(details: Column) -> Column:
    """A map of strings without what may hold text of a document.

    Keys that hint at texts leave.  Numbers, truth values and nulls stay, words
    only under the safe keys and in plain letters; a reason that is not among
    the stated ones becomes ``unspecified``.  A null map stays null.
    """
    plain = lambda v: v.isNull() | v.rlike(_NUMBER)
    hidden = lambda k: reduce(lambda a, b: a | b, [F.contains(F.lower(k), F.lit(x)) for x in TELLING])
    word = lambda k, v: k.isin(*SAFE_KEYS) & ((k == "reason") | v.rlike(_WORD))
    kept = F.map_filter(details, lambda k, v: ~hidden(k) & F.coalesce(plain(v) | word(k, v), F.lit(False)))
    return F.transform_values(kept, lambda k, v: F.when((k == "reason") & ~plain(v) & ~v.isin(*REASONS), "unspecified").otherwise(v))


def with_defaults(given: Column, defaults: Column) -> Column:
    """Two maps as one in which ``given`` wins; a null map counts as empty."""
    none = F.create_map().cast("map<string,string>")
    given, defaults = F.coalesce(given, none), F.coalesce(defaults, none)
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.array_contains(F.map_keys(given), k)), given)


def key_faults(details: Column, required: tuple[str, ...], allowed: tuple[str, ...]) -> Column:
    """Array of ``missing:key`` and ``unknown:key``, required ones first; empty where the map keeps the contract, null map having no keys."""
    keys = F.coalesce(F.map_keys(details), F.array().cast("array<string>"))
    need, may = (F.array(*map(F.lit, x)).cast("array<string>") for x in (required, required + allowed))
    missing = F.transform(F.array_except(need, keys), lambda k: F.concat(F.lit("missing:"), k))
    return F.concat(missing, F.transform(F.array_sort(F.array_except(keys, may)), lambda k: F.concat(F.lit("unknown:"), k)))


def in_order(names: Column, order: tuple[str, ...]) -> Column:
    """An array in the order of a fixed list; other names follow by code point, nulls last."""
    listed = lambda x: F.nullif(F.array_position(F.array(*map(F.lit, order)), x), F.lit(0))
    keyed = F.transform(names, lambda x: F.struct(F.when(x.isNull(), len(order) + 2).otherwise(F.coalesce(listed(x), F.lit(len(order) + 1))).alias("at"), x.alias("name")))
    return F.transform(F.array_sort(keyed), lambda s: s["name"])
