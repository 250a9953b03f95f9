"""A classifier's instructions for a document: their shape, and what they say about its paragraphs and styles.

``instruction_faults`` reads a JSON text per document and the document's tables;
each broken rule is a row, so a document with none is sound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import schemas
from ..session import cut

# The roles, and the style that a role's own definition is named by.
STYLES = {
    "SectionID": "CSI_SectionID__ARCH", "SectionTitle": "CSI_SectionTitle__ARCH", "PART": "CSI_Part__ARCH", "ARTICLE": "CSI_Article__ARCH", "PARAGRAPH": "CSI_Paragraph__ARCH", "SUBPARAGRAPH": "CSI_Subparagraph__ARCH",
    "SUBSUBPARAGRAPH": "CSI_Subsubparagraph__ARCH", "SUBPARAGRAPH_LEVEL_5": "CSI_SubparagraphLevel5__ARCH", "SUBPARAGRAPH_LEVEL_6": "CSI_SubparagraphLevel6__ARCH", "SUBPARAGRAPH_LEVEL_7": "CSI_SubparagraphLevel7__ARCH",
    "SUBPARAGRAPH_LEVEL_8": "CSI_SubparagraphLevel8__ARCH", "END_OF_SECTION": "CSI_EndOfSection__ARCH",
}

_INDEX, _NAME = {"type": "integer", "minimum": 0}, {"type": "string", "minLength": 1}


def _object(required: list[str], **properties) -> dict:
    return {"type": "object", "additionalProperties": False, "required": required, "properties": properties}


# The keys of the instructions and their types.
SCHEMA = _object(
    ["roles"],
    create_styles={"type": "array", "items": _object(["styleId", "derive_from_paragraph_index"], styleId={"type": "string", "enum": list(STYLES.values())}, name={"type": "string"}, type={"const": "paragraph"}, derive_from_paragraph_index=_INDEX, basedOn={"type": ["string", "null"]}, role={"type": "string"})},
    apply_pStyle={"type": "array", "items": _object(["paragraph_index", "styleId"], paragraph_index=_INDEX, styleId=_NAME)},
    ignored_paragraphs={"type": "array", "items": _object(["paragraph_index", "reason"], paragraph_index=_INDEX, reason={"type": "string", "pattern": r"\S"})},
    roles=_object([], **{role: _object(["styleId", "exemplar_paragraph_index"], styleId=_NAME, exemplar_paragraph_index=_INDEX, style_name={"type": ["string", "null"]}) for role in STYLES}),
    notes={"type": "array", "items": {"type": "string"}},
)

#: What makes a paragraph no candidate whatever it says, and what no role may be given to.
STRUCTURAL, EXCLUDED = ("empty", "in_table"), ("editor_note", "specifier_note", "copyright_notice")


def parsed(instructions: DataFrame, payload: str = "payload") -> dict[str, DataFrame]:
    """The tables that sound payloads hold: ``created``, ``applied``, ``ignored`` and ``roles``, each with ``doc_id``."""
    shape = "struct<create_styles: array<struct<styleId: string, derive_from_paragraph_index: bigint, basedOn: string>>, apply_pStyle: array<struct<paragraph_index: bigint, styleId: string>>, ignored_paragraphs: array<struct<paragraph_index: bigint, reason: string>>, roles: map<string, struct<styleId: string, exemplar_paragraph_index: bigint>>>"
    read = cut(instructions.select("doc_id", F.try_parse_json(payload).alias("v")).select("doc_id", F.try_variant_get("v", "$", shape).alias("x"), F.try_variant_get("v", "$.create_styles", "array<map<string,variant>>").alias("keys")))
    created = read.select("doc_id", F.explode(F.arrays_zip(F.col("x.create_styles").alias("c"), F.transform("keys", lambda m: F.array_contains(F.map_keys(m), "basedOn")).alias("k"))).alias("r"))
    return {
        "created": created.select("doc_id", F.col("r.c.styleId").alias("style"), F.col("r.c.derive_from_paragraph_index").alias("at"), F.col("r.c.basedOn").alias("base"), F.col("r.k").alias("has_base")),
        "applied": read.select("doc_id", F.explode("x.apply_pStyle").alias("r")).select("doc_id", F.col("r.paragraph_index").alias("at"), F.col("r.styleId").alias("style")),
        "ignored": read.select("doc_id", F.explode("x.ignored_paragraphs").alias("r")).select("doc_id", F.col("r.paragraph_index").alias("at")),
        "roles": read.select("doc_id", F.explode("x.roles").alias("role", "r")).select("doc_id", "role", F.col("r.styleId").alias("style"), F.col("r.exemplar_paragraph_index").alias("at")),
    }


def shape_faults(instructions: DataFrame, payload: str = "payload") -> DataFrame:
    """``doc_id, rule, place``: where the payloads break ``SCHEMA``; ``rule`` is ``shape:`` and the word broken."""
    told = instructions.select("doc_id", F.explode(schemas.schema_faults(F.col(payload), SCHEMA)).alias("f"))
    return told.select("doc_id", F.concat(F.lit("shape:"), F.col("f.fault")).alias("rule"), F.col("f.path").alias("place"))


def _rows(frame: DataFrame, rule: str | Column, place: Column | str) -> DataFrame:
    rule = F.lit(rule) if isinstance(rule, str) else rule
    return frame.select("doc_id", rule.alias("rule"), (F.col(place) if isinstance(place, str) else place).cast("string").alias("place"))


def _repeated(frame: DataFrame, key: str, rule: str) -> DataFrame:
    return _rows(frame.groupBy("doc_id", key).count().where("count > 1"), rule, key)


def _first_of(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that is broken; what can't be told is not."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for bad, name in rules], F.lit(None).cast("string"))


def _own_faults(t: dict[str, DataFrame]) -> list[DataFrame]:
    """Rules that the payload alone can break."""
    source = t["created"].groupBy("doc_id", "style").agg(F.max("at").alias("source"))
    both = t["applied"].select("doc_id", "at").distinct().join(t["ignored"].distinct(), ["doc_id", "at"])
    other = t["roles"].join(source, ["doc_id", "style"]).where("at <> source")
    return [
        _repeated(t["created"], "style", "created_twice"), _repeated(t["applied"], "at", "styled_twice"), _repeated(t["ignored"], "at", "ignored_twice"), _rows(both, "styled_and_ignored", "at"), _rows(other, "exemplar_is_not_source", "role"),
        _rows(t["applied"].select("doc_id", "style").distinct().join(t["roles"].select("doc_id", "style"), ["doc_id", "style"], "left_anti"), "style_without_role", "style"),
        _rows(t["created"].select("doc_id", "style").distinct().join(t["roles"].select("doc_id", "style"), ["doc_id", "style"], "left_anti"), "created_unused", "style"),
    ]


def _style_faults(t: dict[str, DataFrame], paragraphs: DataFrame, styles: DataFrame, sizes: DataFrame, defaults: DataFrame) -> list[DataFrame]:
    """Rules about the styles that the payload makes, uses and gives to roles."""
    known = styles.select("doc_id", "style", F.lit(True).alias("known")).distinct()
    own = paragraphs.select("doc_id", F.col("paragraph_index").alias("at"), F.col("style").alias("source_style"))
    created = t["created"].join(sizes, "doc_id", "left").join(own, ["doc_id", "at"], "left").join(known, ["doc_id", "style"], "left")
    created = created.join(defaults, "doc_id", "left").join(known.select("doc_id", F.col("style").alias("base"), F.col("known").alias("base_known")), ["doc_id", "base"], "left")
    fallback = F.array_contains("defaults", F.col("base")) | ((F.col("base") == "Normal") & F.col("base_known"))
    wrong_base = F.col("has_base") & ~F.col("base").eqNullSafe(F.col("source_style")) & (F.col("source_style").isNotNull() | ~F.coalesce(fallback, F.lit(False)))
    made = t["created"].select("doc_id", "style", F.lit(True).alias("made")).distinct()

    def reuse(rows: DataFrame, name: str, place: str) -> DataFrame:
        """A style of the document may only be used where the paragraph has it already."""
        told = rows.join(sizes, "doc_id", "left").join(own, ["doc_id", "at"], "left").join(known, ["doc_id", "style"], "left").join(made, ["doc_id", "style"], "left").join(defaults, "doc_id", "left")
        expected = F.when(F.col("source_style").isNotNull(), F.col("style") == F.col("source_style")).otherwise(F.array_contains(F.coalesce("defaults", F.array().cast("array<string>")), F.col("style")))
        rule = _first_of((F.col("at") >= F.col("size"), f"{name}_out_of_range"), (F.coalesce("known", "made").isNull(), f"{name}_unknown_style"), (F.col("known") & ~expected, f"{name}_other_style"))
        return _rows(told, rule, place).where("rule IS NOT NULL")

    canonical = F.element_at(F.create_map(*[F.lit(x) for pair in STYLES.items() for x in pair]), F.col("role"))
    shared = t["roles"].where("role = 'SectionID'").select("doc_id", F.col("style").alias("id_style"), F.col("at").alias("id_at"))
    heads = paragraphs.select("doc_id", F.col("paragraph_index").alias("at"), F.coalesce(F.col("head_and_title"), F.lit(False)).alias("head_and_title"))
    named = t["roles"].join(made, ["doc_id", "style"]).join(shared, "doc_id", "left").join(heads, ["doc_id", "at"], "left")
    one_line = (F.col("role") == "SectionTitle") & (F.col("style") == STYLES["SectionID"]) & (F.col("id_style") == F.col("style")) & (F.col("id_at") == F.col("at")) & F.col("head_and_title")
    return [
        _rows(created.where("known"), "created_exists", "style"), _rows(created.where("at >= size"), "source_out_of_range", "style"), _rows(created.where(F.coalesce(wrong_base, F.lit(False)) & F.coalesce(F.col("at") < F.col("size"), F.lit(False))), "base_is_not_source", "style"),
        _rows(created.where("base IS NOT NULL AND base_known IS NULL"), "base_unknown", "style"), reuse(t["applied"], "applied", "at"), reuse(t["roles"], "role", "role"),
        _rows(named.where((F.col("style") != canonical) & ~F.coalesce(one_line, F.lit(False))), "style_is_not_canonical", "role"),
    ]


def _paragraph_faults(t: dict[str, DataFrame], paragraphs: DataFrame, styles: DataFrame) -> list[DataFrame]:
    """Rules about the paragraphs that are styled, ignored or taken as examples, and about those that are neither."""
    p = paragraphs.withColumnRenamed("paragraph_index", "at").withColumnRenamed("style", "source_style")
    known = styles.select("doc_id", "style", F.lit(True).alias("known")).distinct()
    examples = t["roles"].join(p, ["doc_id", "at"]).join(known, ["doc_id", "style"], "left")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    example = _first_of((blank, "exemplar_blank"), (F.col("skip_reason").isNotNull(), "exemplar_excluded"), (F.col("known") & F.col("direct"), "exemplar_has_own_formatting"), (F.col("strong_role") != F.col("role"), "exemplar_of_other_role"))
    excluded, structural = F.coalesce(F.col("skip_reason").isin(*EXCLUDED), F.lit(False)), F.coalesce(F.col("skip_reason").isin(*STRUCTURAL), F.lit(False))
    ignored = t["ignored"].distinct().join(p, ["doc_id", "at"]).where(~excluded & F.coalesce("numbered", F.lit(False)))
    handled = t["applied"].select("doc_id", "at").union(t["ignored"]).distinct()
    wanted = p.where(~structural).select("doc_id", "at")
    with_payload = handled.select("doc_id").union(t["roles"].select("doc_id")).union(t["created"].select("doc_id")).distinct()
    profile = examples.withColumn("profile", F.to_json(F.struct("source_style", "formatting"), {"ignoreNullFields": "false"}))
    collapsed = profile.groupBy("doc_id", "style").agg(F.count("*").alias("n"), F.count_distinct("profile").alias("kinds")).where("n > 1 AND kinds > 1")
    role_style = t["roles"].select("doc_id", F.col("role").alias("strong_role"), F.col("style").alias("wanted_style"))
    given = t["applied"].groupBy("doc_id", "at").agg(F.max("style").alias("given"))
    strong = p.where("skip_reason IS NULL AND strong_role IS NOT NULL").select("doc_id", "at", "strong_role")
    mismatch = strong.join(role_style, ["doc_id", "strong_role"]).join(given, ["doc_id", "at"], "left").where("given IS NULL OR given <> wanted_style")
    absent = strong.select("doc_id", "strong_role").distinct().join(with_payload, "doc_id", "left_semi").join(role_style, ["doc_id", "strong_role"], "left_anti")
    signed = p.where("skip_reason IS NULL AND signature IS NOT NULL")
    covered = t["roles"].join(signed, ["doc_id", "at"]).select("doc_id", "signature")
    return [
        _rows(examples, example, "role").where("rule IS NOT NULL"), _rows(ignored, "ignored_but_numbered", "at"), _rows(t["applied"].select("doc_id", "at").distinct().join(p, ["doc_id", "at"]).where(excluded), "excluded_but_styled", "at"),
        _rows(wanted.join(with_payload, "doc_id", "left_semi").join(handled, ["doc_id", "at"], "left_anti"), "not_covered", "at"), _rows(handled.join(wanted, ["doc_id", "at"], "left_anti"), "not_to_be_covered", "at"),
        _rows(collapsed, "roles_collapse", "style"), _rows(mismatch, "style_is_not_of_role", "at"), _rows(absent, "role_missing", "strong_role"),
        _rows(signed.select("doc_id", "signature").distinct().join(with_payload, "doc_id", "left_semi").join(covered, ["doc_id", "signature"], "left_anti"), "numbering_not_covered", "signature"),
    ]


def instruction_faults(instructions: DataFrame, paragraphs: DataFrame | None = None, styles: DataFrame | None = None) -> DataFrame:
    """``doc_id, rule, place``: every rule that ``instructions`` (doc_id, payload) break.

    A payload that breaks the schema has its ``shape:`` rows alone.  With
    ``paragraphs`` (doc_id, paragraph_index from 0, text, style, skip_reason,
    direct, numbered, strong_role, signature, formatting, head_and_title) and
    ``styles`` (doc_id, style, is_default) the rules about the document follow.
    ``direct``: the paragraph has formatting of its own; ``strong_role``: the
    role that it surely has; ``signature``: its level's numbering; ``formatting``:
    what must be alike for two roles to share a style.  One payload a document;
    documents without one have no rows.
    """
    wrong = cut(shape_faults(instructions))
    sound = instructions.join(wrong.select("doc_id").distinct(), "doc_id", "left_anti")
    tables = parsed(sound)
    found = [wrong, *_own_faults(tables)]
    if paragraphs is not None and styles is not None:
        mine = cut(paragraphs.join(sound.select("doc_id").distinct(), "doc_id", "left_semi"))
        sizes = mine.groupBy("doc_id").agg(F.count("*").alias("size"))
        default = styles.groupBy("doc_id").agg(F.collect_set(F.when(F.col("is_default"), F.col("style"))).alias("d"), F.max(F.when(F.col("style") == "Normal", F.lit("Normal"))).alias("normal"))
        defaults = default.select("doc_id", F.when(F.size("d") > 0, F.col("d")).when(F.col("normal").isNotNull(), F.array("normal")).otherwise(F.array().cast("array<string>")).alias("defaults"))
        found += _style_faults(tables, mine, styles, sizes, defaults) + _paragraph_faults(tables, mine, styles)
    return reduce(DataFrame.unionByName, found)
