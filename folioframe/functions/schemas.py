"""JSON texts held against a schema; each fault is a row with its path.

The schema is a dict in the words of JSON Schema; it is compiled into one column
expression over the parsed text (VARIANT), so nothing leaves the JVM.  Known
words: type (one or a list), const, enum, minimum, maximum, minLength,
maxLength, pattern, required, properties, additionalProperties (False only),
items, minItems, maxItems; $ref to ``#/$defs/...`` that does not refer back to itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAULTS = "array<struct<path: string, fault: string>>"

#: JSON's names for the kinds of a parsed value; whole numbers of up to 64 bits are integers, 1.0 is none.
_KINDS = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "boolean": ("BOOLEAN",), "null": ("VOID",)}
_KNOWN = {"type", "const", "enum", "minimum", "maximum", "minLength", "maxLength", "pattern", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "$ref"}
_NOTES = {"$schema", "$id", "$defs", "title", "description"}


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _when(bad: Column, path: Column, fault: str) -> Column:
    """One fault or none; what can't be told is no fault."""
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(fault).alias("fault")))).otherwise(F.array().cast(FAULTS))


def _typed(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _node(schema: dict, root: dict, value: Column, path: Column, trail: tuple[str, ...] = ()) -> Column:
    while "$ref" in schema:
        name = schema["$ref"].removeprefix("#/$defs/")
        if name in trail or name not in root.get("$defs", {}):
            raise ValueError(f"reference to {schema['$ref']}")
        schema, trail = root["$defs"][name], (*trail, name)
    if unknown := schema.keys() - _KNOWN - _NOTES:
        raise ValueError(f"unknown words in the schema: {sorted(unknown)}")
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    found = []
    if "type" in schema:
        wanted = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        found.append(_when(~kind.isin(*[k for t in wanted for k in _KINDS[t]]), path, "type"))
    if "const" in schema or "enum" in schema:
        allowed = [schema["const"]] if "const" in schema else schema["enum"]
        if not all(isinstance(x, str) for x in allowed):
            raise ValueError("const and enum hold strings")
        found.append(_when((kind != "STRING") | ~_typed(value, "string").isin(*allowed), path, "const" if "const" in schema else "enum"))
    number, text, items = _typed(value, "double"), _typed(value, "string"), _typed(value, "array<variant>")
    is_number, is_text, is_array = kind.isin(*_KINDS["number"]), kind == "STRING", kind == "ARRAY"
    tests = {
        "minimum": lambda x: is_number & (number < x), "maximum": lambda x: is_number & (number > x), "minLength": lambda x: is_text & (F.length(text) < x), "maxLength": lambda x: is_text & (F.length(text) > x),
        "pattern": lambda x: is_text & ~text.rlike(x), "minItems": lambda x: is_array & (F.size(items) < x), "maxItems": lambda x: is_array & (F.size(items) > x),
    }
    found += [_when(test(schema[word]), path, word) for word, test in tests.items() if word in schema]
    properties = schema.get("properties", {})
    keys = F.map_keys(_typed(value, "map<string,variant>"))
    for key in schema.get("required", []):
        found.append(_when((kind == "OBJECT") & ~F.array_contains(keys, key), F.concat(path, F.lit(f".{key}")), "required"))
    if schema.get("additionalProperties") is False:
        known = F.array(*map(F.lit, properties)) if properties else F.array().cast("array<string>")
        others = F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.lit("unknown").alias("fault")))
        found.append(F.when(kind == "OBJECT", others).otherwise(F.array().cast(FAULTS)))
    for key, inner in properties.items():
        got = F.try_variant_get(value, f"$[{_quoted(key)}]", "variant")
        below = _bound(got, _below(inner, root, F.concat(path, F.lit(f".{key}")), trail))
        found.append(F.when((kind == "OBJECT") & F.array_contains(keys, key), below).otherwise(F.array().cast(FAULTS)))
    if "items" in schema:
        each = F.flatten(F.transform(items, lambda v, i: _node(schema["items"], root, v, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), trail)))
        found.append(F.when(is_array, each).otherwise(F.array().cast(FAULTS)))
    return F.concat(*found) if found else F.array().cast(FAULTS)


def _below(schema: dict, root: dict, path: Column, trail: tuple[str, ...]):
    return lambda value: _node(schema, root, value, path, trail)


def _quoted(key: str) -> str:
    if '"' in key:
        raise ValueError(f"a key with a quotation mark: {key}")
    return f'"{key}"'


def schema_faults(text: Column, schema: dict) -> Column:
    """``array<struct<path, fault>>``: what in a JSON text breaks ``schema``, in its order; empty if nothing does.

    ``path`` begins with ``$``.  ``fault`` is the schema's word that is broken,
    ``unknown`` for a key that it doesn't have, and ``json`` (path ``$``) for a
    null text, one that doesn't parse, or one with a key twice in an object.
    """
    parsed = F.try_parse_json(text)
    broken = F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("fault"))).cast(FAULTS)
    return F.when(parsed.isNull(), broken).otherwise(_bound(parsed, lambda v: _node(schema, schema, v, F.lit("$"))))
