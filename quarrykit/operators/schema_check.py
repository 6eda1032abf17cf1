"""Validation of JSON texts by a JSON schema, compiled to one column expression.

Known keywords: type, required, properties, additionalProperties (false or a
schema), items, minItems, maxItems, enum of plain values, minimum, maximum, minLength,
maxLength, pattern, format date-time. A keyword holds for values of its own
type only, as the standard has it; a keyword that isn't known raises, so that no
rule is passed over in silence. Titles and descriptions say nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

_SAYS_NOTHING = {"$schema", "$id", "$comment", "title", "description", "default", "examples"}
_KNOWN = {"type", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "enum", "minimum", "maximum", "minLength", "maxLength", "pattern", "format"}
#: Date and time with seconds and an offset; the calendar is checked by a cast.
DATE_TIME = r"^\d{4}-\d\d-\d\d[Tt ]([01]\d|2[0-3]):[0-5]\d:([0-5]\d)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$"


def _asked(schema: dict) -> set[str]:
    """The types of values that a schema's own keywords tell apart from the others."""
    by = {"array": {"items", "minItems", "maxItems"}, "object": {"required", "properties", "additionalProperties"}, "number": {"enum", "minimum", "maximum"}, "string": {"minLength", "maxLength", "pattern", "format"}}
    names = schema.get("type", [])
    return {kind for kind, words in by.items() if words & set(schema)} | ({names} if isinstance(names, str) else set(names))


def _kind(v: Column, asked: set[str]) -> Column:
    """The JSON type of a variant that is there: null, boolean, integer, number, string, array or object; 1.0 is an integer. It is right among those asked.

    Only a plain value is asked for its schema, since that of an object or array
    describes all that is in it; and only where integers are told from numbers
    is a fraction looked at.
    """
    whole = F.try_variant_get(v, "$", "double")
    split = F.when(whole == F.floor(whole), "integer").otherwise("number") if "integer" in asked else F.lit("number")

    def named(told: Column) -> Column:
        return (
            F.when(told == "STRING", "string").when(told == "BIGINT", "integer").when(told == "BOOLEAN", "boolean").when(told == "VOID", "null")
            .when(told.startswith("OBJECT"), "object").when(told.startswith("ARRAY"), "array").otherwise(split)
        )

    holds = {"array": "array<variant>", "object": "map<string,variant>"}
    inner = [F.when(F.try_variant_get(v, "$", kind).isNotNull(), name) for name, kind in holds.items() if name in asked]
    return F.coalesce(*inner, _let(F.schema_of_variant(v), named) if asked - set(holds) else F.lit("other"))


def _flat(parts: list[Column]) -> Column:
    # A concat knows its type once; a flatten of an array asks all that is in it again for each row.
    return F.concat(*parts) if parts else F.array().cast("array<string>")


def _when(wrong: Column, path: Column, what: str) -> Column:
    return F.when(F.coalesce(wrong, F.lit(False)), F.array(F.concat(path, F.lit(f": {what}")))).otherwise(F.array().cast("array<string>"))


def _step(key: str) -> str:
    """A key as a step of a variant path."""
    if '"' in key and "'" in key:
        raise ValueError(f"a key with both kinds of quotes can't be looked up: {key}")
    return f"""['{key}']""" if '"' in key else f'["{key}"]'


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _issues(value: Column, body, none: Column | None = None) -> Column:
    """The issues body(value), with the value computed once; ``none``, or no issues, where it is null.

    The null that stands first is what Spark finds when it asks, for each row,
    whether the body can be null, and spares it a walk over the whole body.
    """
    found = _let(value, lambda v: F.when(v.isNull(), F.lit(None).cast("array<string>")).otherwise(body(v)))
    return F.coalesce(found, F.array().cast("array<string>") if none is None else none)


def _check(v: Column, schema: dict | bool, path: Column) -> Column:
    """Issues of a variant that is there."""
    if isinstance(schema, bool):
        return _flat([] if schema else [F.array(F.concat(path, F.lit(": not allowed")))])
    unknown = set(schema) - _KNOWN - _SAYS_NOTHING
    if unknown or schema.get("format", "date-time") != "date-time":
        raise ValueError(f"the schema says what isn't known here: {sorted(unknown) or schema['format']}")
    return _issues(_kind(v, _asked(schema)), lambda kind: _by_kind(v, kind, schema, path))


def _checker(schema: dict | bool, path: Column):
    return lambda v: _check(v, schema, path)


def _by_kind(v: Column, kind: Column, schema: dict, path: Column) -> Column:
    number, text = kind.isin("integer", "number"), kind == "string"
    said, amount = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    out = []
    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        out.append(_when(~kind.isin(*names, *(["integer"] if "number" in names else [])), path, "not of type " + " or ".join(names)))
    if "enum" in schema:
        # An integer equals its decimal form, so numbers compare as such; all else by its JSON.
        plain = [json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in schema["enum"] if isinstance(x, bool) or not isinstance(x, int | float)]
        amounts = [float(x) for x in schema["enum"] if isinstance(x, int | float) and not isinstance(x, bool)]
        held = F.when(number, amount.isin(*amounts) if amounts else F.lit(False)).otherwise(F.to_json(v).isin(*plain) if plain else F.lit(False))
        out.append(_when(~held, path, "not one of the allowed values"))
    for word, wrong in (("minimum", lambda m: amount < m), ("maximum", lambda m: amount > m)):
        if word in schema:
            out.append(_when(number & wrong(float(schema[word])), path, f"beyond the {word} {schema[word]}"))
    for word, wrong in (("minLength", lambda m: F.char_length(said) < m), ("maxLength", lambda m: F.char_length(said) > m)):
        if word in schema:
            out.append(_when(text & wrong(schema[word]), path, f"beyond the {word} {schema[word]}"))
    if "pattern" in schema:
        out.append(_when(text & ~said.rlike(schema["pattern"]), path, "doesn't match the pattern"))
    if "format" in schema:
        # A cast takes a capital T and Z only.
        day = F.try_to_date(F.substring(said, 1, 10), "yyyy-MM-dd")
        out.append(_when(text & (~said.rlike(DATE_TIME) | day.isNull()), path, "no date-time"))
    if {"items", "minItems", "maxItems"} & set(schema):
        elements = F.try_variant_get(F.when(kind == "array", v), "$", "array<variant>")
        if "minItems" in schema:
            out.append(_when(F.size(elements) < schema["minItems"], path, f"beyond the minItems {schema['minItems']}"))
        if "maxItems" in schema:
            out.append(_when(F.size(elements) > schema["maxItems"], path, f"beyond the maxItems {schema['maxItems']}"))
        if "items" in schema:
            each = F.transform(elements, lambda e, i: _check(_there(e), schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            out.append(F.coalesce(F.flatten(each), F.array().cast("array<string>")))
    obj = F.when(kind == "object", v)
    for key in schema.get("required", []):
        out.append(_when(obj.isNotNull() & F.try_variant_get(obj, f"${_step(key)}", "variant").isNull(), path, f"missing {key}"))
    for key, inner in schema.get("properties", {}).items():
        found = F.try_variant_get(obj, f"${_step(key)}", "variant")
        own = F.concat(path, F.lit(f".{key}"))
        out.append(_issues(found, _checker(inner, own)))
    more = schema.get("additionalProperties", True)
    if more is not True:
        pairs = F.map_entries(F.try_variant_get(obj, "$", "map<string,variant>"))
        others = F.filter(pairs, lambda p: ~p["key"].isin(*schema["properties"])) if schema.get("properties") else pairs
        each = F.transform(others, lambda p: _check(_there(p["value"]), more, F.concat(path, F.lit("."), p["key"])))
        out.append(F.coalesce(F.flatten(F.array_sort(each)), F.array().cast("array<string>")))
    return _flat(out)


def _there(v: Column) -> Column:
    """An element of an array or map: a JSON null comes out of the cast as a missing value and is one again."""
    return F.coalesce(v, F.parse_json(F.lit("null")))


def schema_issues(raw: Column, schema: dict) -> Column:
    """What is wrong with a JSON text, as an array of "path: issue" in the order of the schema's keywords; the root's path is ``$``.

    Null, blank or broken text is one issue, ``$: not JSON``. Repeated keys of an
    object are broken JSON here. The schema is data of the call: it is bounded by
    what a plan can hold, some thousands of keywords.
    """
    return _issues(F.try_parse_json(raw), _checker(schema, F.lit("$")), F.array(F.lit("$: not JSON")))
